"""Gap-aware temporal features and classifier evaluation as Spark plans."""
