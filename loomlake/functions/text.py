"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any Unicode kind: what ``(?U)\\s`` matches.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space (of any Unicode kind) at the ends."""
    return F.trim(text, F.lit(_SPACES))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` (and its lambdas) name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_settings(size: int = 1000, overlap: int = 150) -> tuple[int, int]:
    """Size and overlap as used: a bad size is 1000; a bad overlap is 150, or a quarter of a size that is no larger."""
    size = size if size > 0 else 1000
    if 0 <= overlap < size:
        return size, overlap
    return size, 150 if size > 150 else size // 4


def chunks(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Overlapping windows of characters, trimmed, without blank ones; null and blank texts have none.

    The text is cut once into pieces of ``size - overlap`` characters, and a window is made of its piece and
    the next ones, so the work is in proportion to the text.
    """
    size, overlap = chunk_settings(size, overlap)
    step = size - overlap
    reach = -(-size // step)
    none = F.expr("cast(array() as array<string>)")

    def cut(s: Column) -> Column:
        last = F.when(s["n"] <= size, F.lit(0)).otherwise(F.ceil((s["n"] - size) / F.lit(step))).cast("int")
        window = lambda i: trimmed(F.substr(F.array_join(F.slice(s["pieces"], i + 1, F.lit(reach)), ""), F.lit(1), F.lit(size)))
        return F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda x: x != "")

    pieces = lambda t: F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return bound(trimmed(text), lambda t: F.when(F.length(t) > 0, bound(F.struct(pieces(t).alias("pieces"), F.length(t).alias("n")), cut)).otherwise(none))


#: Bracketed runs that one step of the inner fold of ``strip_html`` goes through.
_BLOCK = 256


def strip_html(markup: Column) -> Column:
    """Text outside of tags, white space collapsed.

    Tags may nest to any depth: a ``<`` goes one deeper, a ``>`` one up (at depth 0 it is dropped), and text
    counts at depth 0 only, so a tag that is never closed hides the rest.  Null stays null.
    """
    # Every run begins with a bracket; the first one with one that changes nothing.
    runs = F.regexp_extract_all(F.concat(F.lit(">"), markup), F.lit("(?s)[<>][^<>]*"), F.lit(0))
    state = lambda depth: F.struct(depth.alias("depth"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(s: Column, run: Column) -> Column:
        depth = F.when(F.substring(run, 1, 1) == "<", s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.array_append(s["kept"], F.substr(run, F.lit(2)))).otherwise(s["kept"]).alias("kept"))

    def block(r: Column) -> Callable[[Column, Column], Column]:
        # Kept texts are put together block by block, so that no array grows with every run.
        def fold(s: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(r, i * _BLOCK + 1, F.lit(_BLOCK)), state(s["depth"]), step)
            return bound(inner, lambda x: F.struct(x["depth"].alias("depth"), F.array_append(s["kept"], F.array_join(x["kept"], "")).alias("kept")))

        return fold

    blocks = lambda r: F.sequence(F.lit(0), F.floor((F.size(r) - 1) / _BLOCK).cast("int"))
    text = bound(runs, lambda r: F.aggregate(blocks(r), state(F.lit(0)), block(r), lambda s: F.array_join(s["kept"], "")))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def title(content: Column, limit: int = 60) -> Column:
    """One line of at most so many characters, with an ellipsis if cut."""
    t = F.regexp_replace(F.regexp_replace(content, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def is_json(text: Column) -> Column:
    """Whether the text is one strict JSON value: wrapped in an array it parses and is the only element."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    inner = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))
    return F.coalesce(wrapped.isNotNull() & inner.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.lit(False))


def normalized_reply(text: Column) -> Column:
    """kind and value of a reply: JSON as it stands for a trimmed reply that starts as an object or array and is
    strict JSON, else the trimmed text as a JSON string (``42`` is ``"42"``).  Null stays null."""
    t = trimmed(text)
    json = F.substring(t, 1, 1).isin("{", "[") & is_json(t)
    # A list of one string in JSON, without the list's brackets.
    listed = F.to_json(F.array(t))
    quoted = F.substr(listed, F.lit(2), F.length(listed) - 2)
    return F.when(t.isNotNull(), F.struct(F.when(json, "json").otherwise("text").alias("kind"), F.when(json, t).otherwise(quoted).alias("value")))


def file_format(filename: Column) -> Column:
    """The document format of a file's extension, null if it isn't one."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^./]*)$", 1))
    # Extensions and formats.
    formats = {".pdf": "pdf", ".csv": "csv", ".doc": "doc", ".docx": "docx", ".xls": "xls", ".xlsx": "xlsx", ".html": "html", ".htm": "html", ".txt": "txt", ".md": "md"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in formats.items() for x in pair]), ext)
