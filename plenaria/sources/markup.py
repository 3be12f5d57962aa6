"""XML as a table of its parts in document order, by Spark's functions alone.

Spark's XML source groups children by name and loses their order, so it only judges here whether a document is well formed
and decodes references; a document's tags and texts are rows with places, and windows over these places carry the
enclosing elements forward. No document is parsed in Python, and rows are bounded by a tag or a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Elements below this depth count as text of the deepest one that is followed.
DEPTH = 12

#: Comments, processing instructions and the document type say nothing.
_ASIDE = r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>"
_PART = r"""(?s)<!\[CDATA\[.*?\]\]>|<(?:[^<>"']|"[^"]*"|'[^']*')*+>|[^<]+"""
#: References that need no parser; that of the ampersand is resolved last.
_PLAIN = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#160;": "\xa0", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """A text with its references resolved; only texts with other ones than those of _PLAIN are parsed."""
    parsed = F.from_xml(F.concat(F.lit("<r><t>"), text, F.lit("</t></r>")), "t string", {"ignoreSurroundingSpaces": "false"})
    plain = text
    for of, to in _PLAIN.items():
        plain = F.replace(plain, F.lit(of), F.lit(to))
    other = text.rlike(rf"&(?!(?:{'|'.join(of[1:-1] for of in _PLAIN)});)|\r")
    return F.when(~text.contains("&"), text).when(other, F.coalesce(parsed["t"], text)).otherwise(plain)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag; null if it has none."""
    found = F.regexp_extract(tag, rf"""\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(found != "", decoded(F.substring(found, F.lit(2), F.length(found) - 2)))


def well_formed(xml: Column) -> Column:
    """Whether a text is one element with all that it holds closed in order, and nothing but asides around it."""
    inner = F.from_xml(F.concat(F.lit("<w>"), F.regexp_replace(xml, _ASIDE, ""), F.lit("</w>")), "xs_any array<string>, _VALUE string", {"ignoreSurroundingSpaces": "true"})
    return F.coalesce((F.size(inner["xs_any"]) == 1) & (F.coalesce(inner["_VALUE"], F.lit("")) == ""), F.lit(False))


def parts(documents: DataFrame, names: list[str], key: str = "session_id", xml: str = "xml") -> DataFrame:
    """(key, pos, kind, tag, text, within, named) of every document's tags and texts, in order of pos.

    kind is open, close or text; an empty element is one open part. A document that isn't well formed has one part of kind
    broken. tag is the markup of a tag, text the decoded text of a text. within lists the places (pos) of the elements
    that hold a part from the root on, named their numbers in names (0 for others), 255 names at most; an opening tag's own
    element is the last. Documents should be partitioned by their key, as their parts then stay where they are."""
    whole = F.when(well_formed(F.col(xml)), F.regexp_extract_all(F.regexp_replace(xml, _ASIDE, ""), F.lit(_PART), F.lit(0))).otherwise(F.array(F.lit("")))
    found = documents.select(key, F.posexplode(whole).alias("pos", "part"))
    p = F.col("part")
    raw = p.startswith("<![CDATA[")
    kind = F.when(p == "", "broken").when(~p.startswith("<") | raw, "text").when(p.startswith("</"), "close").otherwise("open")
    found = found.withColumn("kind", kind)
    is_tag = F.col("kind").isin("open", "close")
    number = F.array_position(F.array(*map(F.lit, names)), F.regexp_extract(p, r"^<([^\s/>]+)", 1))
    text = F.when(raw, F.substring(p, F.lit(10), F.length(p) - 12)).when(F.col("kind") == "text", decoded(p))
    opened = (F.col("kind") == "open").cast("int")
    found = found.select(key, "pos", "kind", F.when(is_tag, p).alias("tag"), text.alias("text"), F.when(F.col("kind") == "open", number + F.shiftleft(F.col("pos").cast("long"), 8)).alias("own"), F.when(p.endswith("/>") & is_tag, 0).otherwise(opened).alias("into"))
    so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    change = F.when(F.col("kind") == "close", -1).otherwise(F.col("into"))
    # Open elements around a part; an opening tag's own isn't counted.
    found = found.withColumn("depth", (F.sum(change).over(so_far) - F.col("into")).cast("int"))
    # The last element opened at a depth is that of the largest place.
    found = found.select(key, "pos", "kind", "tag", "text", "own", "depth", *[F.max(F.when(F.col("depth") == d, F.col("own"))).over(so_far).alias(f"level{d}") for d in range(DEPTH)])
    levels = [F.col(f"level{d}") for d in range(DEPTH)]
    held = lambda of: F.slice(F.array(*map(of, levels)), F.lit(1), F.least(F.col("depth") + opened, F.lit(DEPTH)))
    return found.select(key, "pos", "kind", "tag", "text", held(lambda x: F.shiftright(x, 8).cast("int")).alias("within"), held(lambda x: x.bitwiseAND(F.lit(255).cast("long")).cast("int")).alias("named"))
