"""JSON truncation and code signatures: recursive, so in Arrow-batched Python."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAY_LIMIT, SHOWN = 5, 2


def array_keys(items: list) -> list[str] | None:
    """The common keys of the first objects of an array of three objects or more."""
    if len(items) < 3 or not all(isinstance(x, dict) for x in items):
        return None
    keys = sorted(items[0])
    return keys if all(sorted(x) == keys for x in items[:5]) else None


def shrink(value, limit: int = ARRAY_LIMIT):
    if isinstance(value, list):
        if len(value) <= limit:
            return [shrink(x, limit) for x in value]
        keys = array_keys(value)
        note = f"[... {len(value) - SHOWN} more items" + (f", each with keys: {', '.join(keys)}" if keys else "") + "]"
        return [*(shrink(x, limit) for x in value[:SHOWN]), note]
    if isinstance(value, dict):
        return {k: shrink(v, limit) for k, v in value.items()}
    return value


def shrink_json(text: str, limit: int = ARRAY_LIMIT) -> str:
    """JSON with long arrays cut to two items and a note; other texts unchanged."""
    try:
        return json.dumps(shrink(json.loads(text), limit), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def _calls(node: ast.AST) -> list[str]:
    names = (c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None for c in ast.walk(node) if isinstance(c, ast.Call))
    return list(dict.fromkeys(n for n in names if n))


def _function(f, pad: str) -> list[str]:
    head = "async def" if isinstance(f, ast.AsyncFunctionDef) else "def"
    out = [f"{pad}{head} {f.name}({ast.unparse(f.args)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "") + ":"]
    if doc := ast.get_docstring(f):
        out.append(f'{pad}    """{doc.splitlines()[0]}"""')
    if calls := _calls(f):
        out.append(f"{pad}    # calls: {', '.join(calls[:8])}")
    return [*out, f"{pad}    ..."]


def python_signatures(code: str) -> str | None:
    """Functions and classes of Python source, bodies left out; None if it can't be parsed or has none."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[str] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += _function(node, "")
        elif isinstance(node, ast.ClassDef):
            bases = ", ".join(map(ast.unparse, node.bases))
            out.append(f"class {node.name}" + (f"({bases})" if bases else "") + ":")
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append(f"    def {m.name}({ast.unparse(m.args)}): ...")
    return "\n".join(dict.fromkeys(out)) if out else None


_JS = re.compile(r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:class\s+\w+|function\s*\w*\s*\(|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\()")
_PY = re.compile(r"^\s*(?:async\s+def|def|class)\s+\w+")
_FENCE = re.compile(r"(```\w*\n)([\s\S]*?)(```)")
_IMPORT = re.compile(r"^\s*(?:import\b|from\s+\S+\s+import\b|(?:const|let|var)\s+.+=\s*require\()")


def _signed(body: str) -> str | None:
    """Signatures of one piece of code; None if it has none."""
    found = python_signatures(body)
    if found is None:
        lines = body.split("\n")
        js = any(_JS.match(x) for x in lines) and not any(_PY.match(x) for x in lines)
        picked = [x.rstrip() if _IMPORT.match(x) else x.rstrip().rstrip("{").rstrip() + (" { ... }" if js else "  ...") for x in lines if _IMPORT.match(x) or (_JS if js else _PY).match(x)]
        found = "\n".join(dict.fromkeys(picked)) if any((_JS if js else _PY).match(x) for x in lines) else None
    return found


def signatures(code: str) -> str:
    """Signatures of code, from its syntax tree or else line by line; code without any, or not longer, stays as it is. In a
    text with fences the code of each is rewritten in its place, and the text around them stays."""
    if "```" in code and _FENCE.search(code):
        return _FENCE.sub(lambda m: m[1] + (found.rstrip("\n") + "\n" if (found := _signed(m[2])) is not None and len(found) < len(m[2]) else m[2]) + m[3], code)
    found = _signed(code)
    return code if found is None or len(found) >= len(code) else found


def structured(rows: DataFrame, limit: int = ARRAY_LIMIT, keep_signatures: bool = True) -> DataFrame:
    """STRUCTURAL rows with shorter JSON, SIGNATURE rows as signatures."""

    @F.pandas_udf("string")
    def rewrite(content: pd.Series, policy: pd.Series) -> pd.Series:
        return pd.Series([shrink_json(c, limit) if p == "STRUCTURAL" else signatures(c) if p == "SIGNATURE" and keep_signatures else c for c, p in zip(content, policy, strict=True)], dtype=object)

    eligible = F.col("policy").isin("STRUCTURAL", "SIGNATURE")
    return rows.withColumn("content", F.when(eligible, rewrite("content", "policy")).otherwise(F.col("content")))
