"""Page layouts: each is a column expression over ``nodes`` and ``runs``."""

from __future__ import annotations

from tidemark.functions.shred import Keep

# All elements and attributes that some layout looks at, and the elements whose own
# string is tested. Others are dropped when a page is shredded for extraction.
LAYOUT_TAGS = (
    "a b blockquote div form h1 h2 h3 h4 h5 input li ol p span strong table td time tr ul".split()
)
LAYOUT_ATTRS = "class data-testid datetime href id name value".split()
LAYOUT_OWN = "h1 h2 h3 h4 h5 span".split()
LAYOUT_FIELDS = "i j up parent child_idx tag attrs classes own t0 t1".split()

LAYOUT_KEEP = Keep(
    frozenset(LAYOUT_TAGS), frozenset(LAYOUT_ATTRS), frozenset(LAYOUT_OWN), frozenset(LAYOUT_FIELDS)
)
