"""Word lists, patterns, tables and formats that results depend on."""

# Content types and the policy of each.
POLICIES = {
    "SYSTEM_PROMPT": "PRESERVE",
    "USER_QUERY": "PRESERVE",
    "PREVIOUSLY_COMPRESSED": "PRESERVE",
    "RECENT_TURN": "LIGHT",
    "TOOL_RESULT_JSON": "STRUCTURAL",
    "TOOL_RESULT_TEXT": "MODERATE",
    "CODE_BLOCK": "SIGNATURE",
    "ERROR_TRACE": "STACK",
    "ASSISTANT_REASONING": "AGGRESSIVE",
    "OLD_CONVERSATION": "AGGRESSIVE",
}
#: Types that no layer rewrites or drops.
PROTECTED = ("SYSTEM_PROMPT", "USER_QUERY", "RECENT_TURN", "PREVIOUSLY_COMPRESSED")

# Signs of an error trace (three hits make one).
ERROR_SIGNS = (
    r"Traceback \(most recent",
    r"(?m)^\s+at .+\(.+:\d+\)",
    r"Error: .+\n\s+at",
    r"panic:",
    r"Exception in thread",
    r"(?m)^\s+File \".+\", line \d+",
    r"raise \w+Error",
    r"throw new \w*Error",
    r"panic!\(",
    r"(?i)Unhandled\s+(?:promise\s+)?rejection",
    r"(?m)^\s+at Object\.<anonymous>",
)
CODE_TOOLS = ("read_file", "cat", "view_file", "get_file_contents", "ReadFileTool", "read", "Read")
EDIT_TOOLS = ("edit_file", "write_file", "create_file", "patch_file", "Edit", "Write", "edit", "write")

# Line cleanup.
PATH = r"(?:[A-Za-z]:)?(?:[/\\][\w.\-]+)+(?:\.\w+)?(?::\d+)?"
BOILERPLATE = (r"(?m)^#\s*-\*-\s*coding:", r"(?m)^(?:MIT License|Apache License|Copyright \(c\))", r"(?m)^(?:={5,}|-{5,}|_{5,}|\*{5,}|~{5,})$")
DEFINITION = r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:class|def|function|const|let|var|interface|type|enum)\s+\w+"

# Words that are never pruned (whole-word patterns).
KEPT_WORDS = (
    r"(?:[A-Za-z]:)?[\w.\-]+(?:[/\\][\w.\-]+)+(?::\d+)?",
    r"\d[\d.,:]*",
    r"[a-z]+(?:[A-Z][a-z]+)+",
    r"[a-z]+(?:_[a-z]+)+",
    r"[A-Z][A-Z_]+",
    r"https?://\S+",
    r"\S+@\S+\.\S+",
    r"[A-Za-z0-9]{10,}",
    r"(?:ORD|RET|INV|TXN|REF)-[\w\-]+",
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    r"[A-Z]{2,4}-\d{4,}",
)

# Importance.
ENTITIES = r"(?:[A-Za-z]:)?[\w.\-]+(?:[/\\][\w.\-]+)+(?:\.\w+)?|https?://\S+|\b[a-z]+(?:[A-Z][a-z]+)+\b|\b[a-z]+(?:_[a-z]+)+\b|\bclass\s+\w+|\bdef\s+\w+|\bfunction\s+\w+|\b[A-Z][A-Z_]{2,}\b"
NUMBERS = r"(?i)\bline\s+\d+\b|\bport\s+\d+\b|\b\d+\s*(?:items?|rows?|records?|files?|bytes?|KB|MB|GB)\b|\bv?\d+\.\d+(?:\.\d+)?\b|\b(?:0x[0-9a-f]+|E\d{4,})\b|\b\d{3,}\b"
QUESTION = r"(?m)\?\s*$"
CONCLUSION = r"(?i)\b(?:therefore|in conclusion|the result is|this means|in summary|to summarize|the key takeaway|ultimately|finally)\b"
DECISION = r"(?i)\b(?:decided to|chose|let's go with|I'll use|we'll use|the decision is|going with|selecting)\b"
ABSOLUTE = r"(?i)\b(?:must|never|always|required|mandatory|critical|essential|do not|don't ever|absolutely)\b"
IMPERATIVE = r"(?i)\b(?:use|run|install|create|add|remove|delete|update|set|configure|ensure|make sure|implement|deploy|fix|change)\b"
CONDITIONAL = r"(?i)\b(?:if\b.{1,40}\bthen|only when|unless|when\b.{1,40}\bshould|in case|provided that)\b"
HEDGED = r"(?i)\b(?:maybe|consider|could|might|perhaps|possibly|optionally)\b"
STOP_WORDS = "a an the and or but in on at to for of with by from is are was were be been have has had do does did will would could should this that it its i me my we you he she they not no so if then just also".split()

# Keywords of a task.
TASK_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can shall this that these those it its i me my we our you your he she they them their what which who when where why how not no so if then than just also very too all any some each"
).split()

# Clauses that elaborate.
SATELLITE = r"(?i)^\s*(?:for example|e\.g\.|such as|in other words|specifically|to clarify|note that|in particular|because|since|as a result|as mentioned|which is why|this means that|namely)"
PARENTHETICAL = r"^\s*\(.*\)\s*$"
NUMBERED = r"^\s*\d+\.\s+"

# Facts.
FILE_PATH = r"""(?:^|\s|["'])((?:[a-zA-Z]:)?(?:[./\\])?(?:[\w.\-]+[/\\])*[\w.\-]+\.\w{1,10})(?::\d+)?"""
ERROR_LINE = r"((?:TypeError|ReferenceError|SyntaxError|ValueError|KeyError|AttributeError|ImportError|RuntimeError|Exception|Error|FAIL):\s*.{10,200})"
LINE_REF = r"([\w./\\]+:\d+)"
URL = r"(https?://\S+)"
CODE_ENTITIES = (r"\bclass\s+(\w+)", r"\bdef\s+(\w+)", r"\bfunction\s+(\w+)", r"\basync\s+(\w+)\s*\(", r"(?:get|set)\s+(\w+)\s*\(")
DATE = r"(?i)\b(\d{4}-\d{2}-\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b"
TRACKING = r"\b([A-Z0-9]{15,30})\b"
STATUTE = r"(?i)\b(\d+\s+U\.S\.C\.\s*(?:§|Section)\s*\d+(?:\([a-z]\))?|Section\s+\d+(?:\.\d+)*(?:\([a-z]\))?|Article\s+\d+)"
MONEY = r"(\$[\d,]+(?:\.\d{2})?)"
PERCENT = r"(\b\d+(?:\.\d+)?%)"
TERM = r"(?i)\b([a-z]{8,}(?:ide|ine|ase|ose|ate|ism|itis|emia|opathy|amine|mycin|cillin|prazole|sartan|statin))\b"
DECISION_SENTENCE = r"(?i)\bI'll use\b|\bLet's go with\b|\bchoosing\b.{1,60}\bbecause\b|\bchose\b|\bdecided to\b|\bI'll go with\b|\bwe(?:'ll| will) use\b"
HEDGE = r"(?i)\b(?:maybe|perhaps|could consider|might want to|possibly|not sure)\b|\?"
CHAIN = r"(?i)\b(?:therefore|so we can|which means|building on that|given that|as established|as a result|consequently|based on this|following from|this confirms|thus|hence)\b"
HIGH_VALUE = ("Tracking:", "Date:", "Statute:", "Amount:", "Metric:", "ID:", "UUID:", "URL:")
FACT_LABELS = ("Tool used: ", "Code entity: ", "Reference: ")

# What a summary must keep.
SUMMARY_PATH = r"(?:[\p{L}\p{N}_.\-]+[/\\])+[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]{1,10}(?::\d+)?"
SUMMARY_ERROR = r"(TypeError|ReferenceError|SyntaxError|ValueError|KeyError|AttributeError|ImportError|RuntimeError|Error):\s*.{10,100}"

# Questions, deliberations, resolutions, corrections.
ARC_QUESTION = r"(?i)\bwhich (?:one|approach|option)\b|\bhow (?:to|should|do)\b|\bwhat (?:about|if)\b"
DELIBERATION = r"(?i)\balternatively\b|\bon (?:one|the other) hand\b|\bpros and cons\b|\boption [A-Z]\b|\bcould (?:also |either )?use\b|\bvs\.?\b|\bcompare\b|\btradeoff\b"
RESOLUTION = r"(?i)\bI'll use\b|\bLet's go with\b|\bchoosing\b.{1,60}\bbecause\b|\bdecided to\b|\bI'll go with\b|\bwe(?:'ll| will) use\b|\bgoing with\b|\bthe (?:best|right) (?:choice|approach|option) is\b"
SUPERSESSION = r"(?i)\bactually\b|\bturns out\b|\bcorrection\b|\bnot .{1,30} but\b|\bupdated?\b.*\bnow\b|\ball \d+ tests? pass"
ARC_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been have has had do does did will would could should may might can not no if then else this that these those it its we you they use using used going think want need like"
).split()

# Model prefixes, their context windows and output reserves (see plans.config for the look-up).
PHASES = {"DEBUGGING": 1.1, "IMPLEMENTATION": 1.05, "REVIEW": 1.0, "EXPLORATION": 0.95}
#: recent ratio, budget ratio, keep multiplier, entropy multiplier
PRESSURE = {"NONE": (0.30, None, 1.0, 1.0), "LOW": (0.20, 0.90, 1.0, 1.0), "MEDIUM": (0.12, 0.70, 0.85, 0.90), "HIGH": (0.08, 0.50, 0.70, 0.75), "CRITICAL": (0.05, 0.30, 0.50, 0.55)}
ENGINES = {
    "NONE": (),
    "LOW": ("dedup", "verbatim"),
    "MEDIUM": ("dedup", "verbatim", "pruner", "structural", "discourse"),
    "HIGH": ("dedup", "verbatim", "pruner", "structural", "discourse", "importance", "relevance"),
    "CRITICAL": ("dedup", "verbatim", "pruner", "structural", "discourse", "importance", "relevance", "summarizer"),
}
