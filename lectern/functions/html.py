"""HTML-to-text expressions for archived pages (flat markup), JVM-side.

A page is treated as a string; elements are selected with regular expressions
and their text is the text nodes between tags, entity-decoded, stripped of
Unicode whitespace and with blanks dropped, as ``get_text(sep, strip=True)``
would return it.  Scripts, styles and comments are removed first (a script may
contain a literal ``"</p>"``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import py_strip
from lectern.functions.fixed import CONTENT_NOT_FOUND

NOISE_RE = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG_RE = r"<[^>]*>"
# Group 1 is the quoted address (either quote), group 2 the inner HTML; any case, across lines.
LINK_RE = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*')[^>]*>(.*?)</a\s*>"""
PARAGRAPH_RE = r"(?s)<p[^>]*>(.*?)</p>"

# Named/numeric entities decoded in text nodes; "&amp;" is decoded last so that
# "&amp;lt;" becomes "&lt;" (a single decoding pass).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def remove_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE_RE, "")


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def element_inner(html: Column, open_re: str, tag: str) -> Column:
    """Inner HTML of the first element whose opening tag matches ``open_re``
    (non-nested: up to the first closing ``</tag>``); null when absent."""
    pat = rf"(?s){open_re}(.*?)</{tag}>"
    return F.when(html.rlike(pat), F.regexp_extract(html, pat, 1))


def text_nodes(fragment: Column, sep: str) -> Column:
    """``get_text(sep, strip=True)`` of a fragment; null stays null."""
    nodes = F.split(fragment, TAG_RE)
    cleaned = F.transform(nodes, lambda x: py_strip(decode_entities(x)))
    return F.array_join(F.filter(cleaned, lambda x: x != F.lit("")), sep)
