"""streamfactor: online matrix factorization over rating streams, on Spark DataFrames."""

from streamfactor.config import MFConfig

__all__ = ["MFConfig"]
