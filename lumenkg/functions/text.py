"""Text of HTML, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters after which a line end stays.
ENDS = ".!:;"
# Entities of HTML that are replaced; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def folded_lines(text: Column) -> Column:
    """Line ends go, but for those after one of ENDS.

    A kept line end is passed over together with the character after it, so of two in a row the second
    stays as well; a lone line end at the end of the text stays, too.
    """
    kept = F.regexp_replace(text, rf"([{ENDS}]\n)\n", "$1\u0001")
    kept = F.regexp_replace(kept, rf"([{ENDS}])\n", "$1\u0001")
    kept = F.regexp_replace(kept, r"\n(?!\z)", "")
    return F.translate(kept, "\u0001", "\n")


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, ends of blocks become line ends, entities are resolved, lines are folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title|/article|/section)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, c in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(c))
    return folded_lines(F.trim(F.regexp_replace(t, r" *\n *", "\n")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
