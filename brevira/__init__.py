"""brevira: transcript shrinking over many conversations at once, expressed as Spark DataFrame plans."""
