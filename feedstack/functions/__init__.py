"""Column builders: every function takes and returns ``Column``s, so it stays
inside whole-stage codegen and composes with ``select``/``withColumn``."""
