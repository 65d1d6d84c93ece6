"""The prose of HTML, as lines for the same checks as any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is no prose, with all it holds.
HIDDEN = ("script", "style", "template", "noscript")
#: Tags that begin and end a block of text.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h[1-6]", "head", "header", "hr", "html", "legend", "main", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "li")
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))

GONE = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in HIDDEN)
HEADING = r"(?i)<h[1-6](?:\s[^>]*)?>"
LIST_ITEM = r"(?i)<li(?:\s[^>]*)?>"
BREAK = r"(?i)<br\s*/?(?:\s[^>]*)?>"
BLOCK_TAG = rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?/?>"
TAG = r"<[A-Za-z/!?][^>]*>"
#: (pattern, what it becomes), in order. A heading and a list item begin with the marks that they have in plain text.
STEPS = ((GONE, " "), (r"[\t\n\f\r ]+", " "), (HEADING, "\n\n# "), (LIST_ITEM, "\n\n- "), (BREAK, "\n"), (BLOCK_TAG, "\n\n"), (TAG, ""))


def prose(html: Column) -> Column:
    """The text of a page: blocks are apart by a blank line, headings and list items are marked, other tags go, and entities are read.

    A null page has null prose. A tag or section that is not closed stays as
    text. Numeric entities are read up to the largest code point; named ones
    that are not listed stay.
    """
    text = html
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new)
    cut = F.split(F.regexp_replace(text, r"&#(\d{1,7});", "\x01$1\x02"), "\x01")
    number = lambda p: F.substring_index(p, "\x02", 1).cast("int")
    rest = lambda p: F.substring(p, F.instr(p, "\x02") + 1, F.length(p))
    char = lambda p: F.when(number(p).between(32, 0xD7FF) | number(p).between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number(p)), 8, "0")), "UTF-32")).otherwise(" ")
    text = F.when(text.contains("&#"), F.array_join(F.transform(cut, lambda p, i: F.when(i == 0, p).otherwise(F.concat(char(p), rest(p)))), "")).otherwise(text)
    for name, char_of in ENTITIES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char_of))
    return text
