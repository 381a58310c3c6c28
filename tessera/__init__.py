"""tessera: paired-text data operators expressed as Spark DataFrame plans."""

from tessera.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
