"""SQL expressions of logistic models and of the FTRL-proximal update.

The learners repeat these for every label, so they are built as SQL text: one parse per
expression instead of a call into the JVM per operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrill.config import FtrlConfig


def number(value: float) -> str:
    """A DOUBLE literal."""
    return f"{float(value)!r}D"


def text(value: str) -> str:
    """A STRING literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def logistic(margin: str) -> str:
    """Probability of a margin. ``exp`` overflows to infinity, which gives 0 as it should."""
    return f"(1.0D / (1.0D + exp(-({margin}))))"


def hard_label(probability: str) -> str:
    """L7b. 1.0 above one half, else 0.0."""
    return f"(CASE WHEN {probability} > 0.5D THEN 1.0D ELSE 0.0D END)"


def log_loss(margin: str, target: str) -> str:
    """L2. Logistic loss: ln(1+e^-m) for a positive row, that plus m for a negative one.

    Written so that no exponent is positive, which keeps it finite for any margin.
    """
    base = f"(log1p(exp(-abs({margin}))) + greatest(-({margin}), 0.0D))"
    return f"(CASE WHEN {target} > 0 THEN {base} ELSE {base} + {margin} END)"


def ftrl_weight(z: str, n: str, cfg: FtrlConfig) -> str:
    """L1. Weight of a coordinate from its state; exactly 0 while abs(z) <= lambda1."""
    shrunk = f"({z} - signum({z}) * {number(cfg.lambda1)})"
    rate = f"({number(cfg.lambda2)} + ({number(cfg.beta)} + sqrt({n})) / {number(cfg.alpha)})"
    return f"(CASE WHEN abs({z}) <= {number(cfg.lambda1)} THEN 0.0D ELSE -{shrunk} / {rate} END)"


def ftrl_delta_z(g: str, n: str, w: str, cfg: FtrlConfig) -> str:
    """L3. Change of z for one row, from the state at the start of the pass."""
    return f"({g} - (sqrt({n} + {g} * {g}) - sqrt({n})) / {number(cfg.alpha)} * {w})"


def ftrl_delta_n(g: str) -> str:
    """L3. Change of n for one row."""
    return f"({g} * {g})"


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Round for reporting; adding 0 turns a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)
