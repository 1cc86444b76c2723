"""textrill: online classification of short text as PySpark DataFrame jobs."""

from textrill.config import FtrlConfig, JoinPolicy, SgdConfig, TextConfig

__all__ = ["FtrlConfig", "JoinPolicy", "SgdConfig", "TextConfig"]
