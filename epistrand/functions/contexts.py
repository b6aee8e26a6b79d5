"""Cytosine contexts: which characters of a methylation string are in or out of a context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """Upper case: methylated. ``out_*`` is what thresholding counts as out of context."""

    name: str
    meth: str
    unmeth: str
    out_meth: str
    out_unmeth: str

    @property
    def reported(self) -> tuple[str, ...]:
        """Classes (CHH, CHG, CG) that a report on this context shows."""
        return tuple(n for c, n in (("H", "CHH"), ("X", "CHG"), ("Z", "CG")) if c in self.meth)


# Context -> character sets. U/u counts in CX only and is never out of context here.
CONTEXTS = {
    "CG": Context("CG", "Z", "z", "XH", "xh"),
    "CHG": Context("CHG", "X", "x", "ZH", "zh"),
    "CHH": Context("CHH", "H", "h", "ZX", "zx"),
    "CxG": Context("CxG", "ZX", "zx", "H", "h"),
    "CX": Context("CX", "ZXHU", "zxhu", "", ""),
}


def context(name: str) -> Context:
    if name not in CONTEXTS:
        raise ValueError(f"unknown context {name!r}; one of {', '.join(CONTEXTS)}")
    return CONTEXTS[name]


def n_of(xm: Column | str, chars: str) -> Column:
    """How often any of ``chars`` occurs in the string: its length less that without them, which makes no array of matches."""
    whole = left = xm if isinstance(xm, Column) else F.col(xm)
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(whole) - F.length(left) if chars else F.lit(0)


def beta(xm: Column | str, meth: str, unmeth: str) -> Column:
    """Share of methylated sites of a read; 0 without sites."""
    m, u = n_of(xm, meth), n_of(xm, unmeth)
    return F.coalesce(F.try_divide(m.cast("double"), (m + u).cast("double")), F.lit(0.0))


def passes(ctx: Context, min_sites: int = 2, min_beta: float = 0.5, max_out_beta: float = 0.1, xm: str = "xm") -> Column:
    """Whether a read carries an epiallele: enough methylated sites in context, few out of it."""
    m, u, om, ou = n_of(xm, ctx.meth), n_of(xm, ctx.unmeth), n_of(xm, ctx.out_meth), n_of(xm, ctx.out_unmeth)
    share = lambda a, b: F.try_divide(a.cast("double"), (a + b).cast("double"))
    return ~((m == 0) | (m + u < min_sites) | (share(m, u) < min_beta) | F.coalesce((om > 0) & (share(om, ou) > max_out_beta), F.lit(False)))
