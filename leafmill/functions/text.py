"""Text functions as column expressions: no Python runs for them on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the browser's language, and the invisible characters that texts and titles lose.
SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
INVISIBLE = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"
#: The same as character classes that turn most letters away by one comparison.
ANY_SPACE, ANY_INVISIBLE = f"[[^!-~]&&[{SPACE}]]", f"[[^ -~]&&{INVISIBLE}]"
TITLE_INVISIBLE = r"[\x{0}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]+"


def text_of(value: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def strip_all(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(value, f"^[{SPACE}]+", ""), f"{ANY_SPACE}+$", "")


def strip_invisible(value: Column) -> Column:
    return F.regexp_replace(text_of(value), ANY_INVISIBLE, "")


def normalize_text(value: Column) -> Column:
    """One space for each run of white space, none at the ends, no invisible characters."""
    return F.trim(F.regexp_replace(strip_invisible(value), f"{ANY_SPACE}+", " "))


def normalize_code(value: Column) -> Column:
    return strip_all(F.replace(strip_invisible(value), F.lit("\r\n"), F.lit("\n")))


def normalize_indented_code(value: Column) -> Column:
    """Line ends as LF, none of them at the ends, no white space before them; indentation stays."""
    lines = F.regexp_replace(strip_invisible(value), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+(?=[\n\x{2028}\x{2029}]|\z)", ""), r"^\n+", ""), r"\n+$", "")


def normalize_inline_markdown(value: Column) -> Column:
    out = F.regexp_replace(strip_invisible(value), r"[ \t\f\x0B]+", " ")
    return strip_all(F.regexp_replace(out, r" *<br> *", "<br>"))


def inline_markdown_to_text(value: Column) -> Column:
    out = F.regexp_replace(text_of(value), r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
    return normalize_text(F.regexp_replace(out, r"[*~]+", ""))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units, as the browser counts it."""
    return (F.octet_length(F.encode(text_of(value), "UTF-16BE")) / 2).cast("long")


def trimmed_text(value: Column) -> Column:
    return strip_all(F.replace(text_of(value), F.lit("\r\n"), F.lit("\n")))


def escape_label(value: Column) -> Column:
    out = trimmed_text(value)
    for mark in ("\\", "[", "]"):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def escape_url(value: Column, spaces: bool = True) -> Column:
    """Parentheses, and spaces if wanted, as per-cent codes."""
    out = strip_all(text_of(value))
    for mark, code in ((" ", "%20"), ("(", "%28"), (")", "%29")):
        if mark != " " or spaces:
            out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def table_cell(value: Column) -> Column:
    out = F.regexp_replace(strip_invisible(value), r"\r?\n", "<br>")
    return strip_all(F.replace(out, F.lit("|"), F.lit("\\|")))


def wrap_inline(value: Column, marker: str) -> Column:
    """The marker around the text, white space outside it; blank stays as it is."""
    marked = F.regexp_replace(text_of(value), f"(?s)^([{SPACE}]*)(.*?)([{SPACE}]*)$", f"$1{marker.replace('$', '')}$2{marker}$3")
    return F.when(strip_all(text_of(value)) == "", text_of(value)).otherwise(marked)


def list_depth(value: Column) -> Column:
    depth = F.floor(value.try_cast("double"))
    return F.when(depth > 0, depth).otherwise(F.lit(0)).cast("int")


def code_language(value: Column) -> Column:
    low = F.lower(normalize_text(value))
    return F.when(low.isin("plain text", "plaintext", "txt"), "text").when(low == "md", "markdown").otherwise(low)


def heading_level(classes: Column) -> Column:
    """From a class doc-heading-1 to doc-heading-9, 6 at most; null without one."""
    digits = F.filter(F.transform(classes, lambda c: F.regexp_extract(c, r"^doc-heading-([1-9])$", 1)), lambda d: d != "")
    return F.when(F.size(digits) > 0, F.least(F.get(digits, F.lit(0)).cast("int"), F.lit(6)))


# Characters that file names may not have, and the most characters of a file name and of a title.
UNSAFE = r'[\\/:*?"<>|]+'
MOST_NAME, MOST_TITLE = 120, 80


def file_name(value: Column) -> Column:
    """A safe file name of at most 120 characters."""
    out = F.regexp_replace(normalize_text(value), UNSAFE, "-")
    out = F.regexp_replace(F.regexp_replace(out, r"-+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(out, 1, MOST_NAME), r"-+$", ""), F.lit("")), F.lit("web-clip"))


def title_name(value: Column) -> Column:
    """A safe title of at most 80 characters."""
    out = F.regexp_replace(F.regexp_replace(text_of(value), TITLE_INVISIBLE, " "), UNSAFE, "-")
    out = F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"-+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(out, 1, MOST_TITLE), f"[-.{SPACE}]+$", ""), F.lit("")), F.lit("web-clip"))


def export_names(title: Column, captured: Column) -> Column:
    """The names of an export: a struct of safe_title, timestamp, base_name, zip_name, folder_name, markdown_name, assets_dir."""
    safe, stamp = title_name(title), F.date_format(captured, "yyyyMMdd-HHmm")
    base = F.concat(safe, F.lit("__"), stamp)
    return F.struct(
        safe.alias("safe_title"),
        stamp.alias("timestamp"),
        base.alias("base_name"),
        F.concat(base, F.lit(".zip")).alias("zip_name"),
        base.alias("folder_name"),
        F.concat(safe, F.lit(".md")).alias("markdown_name"),
        F.concat(safe, F.lit(".assets")).alias("assets_dir"),
    )


def captured_at(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd HH:mm")


def overlap_merge(left: Column, right: Column, least: int = 12) -> Column:
    """Both texts joined where the end of one is the longest start of the other, of least units or more; else null."""
    pair = F.struct(normalize_text(left).alias("a"), normalize_text(right).alias("b"))
    tail = lambda p: F.struct(p["a"], p["b"], F.right(p["a"], F.least(F.length(p["a"]), F.length(p["b"]))).alias("tail"))

    def merged(p: Column) -> Column:
        # only places where the start of b occurs are tested: the look-ahead cuts the tail before each of them, also where they overlap
        start = F.replace(F.left(p["b"], F.lit(least)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        pieces = F.split(p["tail"], F.concat(F.lit("(?=\\Q"), start, F.lit("\\E)")))

        def tested(s: Column, piece: Column) -> Column:
            fits = (s["rest"] >= least) & (F.right(p["tail"], s["rest"]) == F.left(p["b"], s["rest"]))
            return F.struct((s["rest"] - F.length(piece)).alias("rest"), F.coalesce(s["size"], F.when(fits, s["rest"])).alias("size"))

        first = F.struct(F.length(p["tail"]).alias("rest"), F.lit(None).cast("int").alias("size"))
        size = F.aggregate(pieces, first, tested, lambda s: s["size"])
        return F.transform(F.array(size), lambda n: F.when(n.isNotNull(), F.concat(p["a"], F.substring(p["b"], n + 1, F.length(p["b"])))))

    # as the element of an array, the normalised texts are worked out once and not for each place; so is the size
    return F.get(F.flatten(F.transform(F.transform(F.array(pair), tail), merged)), F.lit(0))


def escape_controls(value: Column) -> Column:
    out = text_of(value)
    for mark, code in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def log_details(entries: Column) -> Column:
    """key=value pairs of an array of (key, value) in its order."""
    return F.array_join(F.transform(entries, lambda e: F.concat(escape_controls(e["key"]), F.lit("="), escape_controls(e["value"]))), " ")


def log_line(module: Column, message: Column, entries: Column) -> Column:
    details = log_details(entries)
    return F.concat(F.lit("["), escape_controls(module), F.lit("] "), escape_controls(message), F.when(details != "", F.concat(F.lit(" "), details)).otherwise(F.lit("")))


# What of Markdown is no text, and what stands for it: fences, images, links, breaks, line markers, emphasis.
MARKDOWN = (
    (r"```[^\n]*\n?", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?i)<br\s*/?\s*>", " "),
    (r"(?m)^[ \t]*(?:#{1,6}|>|[-+*]|\d+[.)])\s+", ""),
    (r"[|*_~`\\]", " "),
)
#: What each pattern of MARKDOWN can't do without; null where no fixed text is sure.
_NEEDS = ("```", "](", "](", "<", None, None)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def markdown_to_text(value: Column) -> Column:
    """Plain text of Markdown."""
    out = text_of(value)
    for (pattern, with_), needed in zip(MARKDOWN, _NEEDS):
        out = F.regexp_replace(out, pattern, with_) if needed is None else _where_it_has(out, needed, pattern, with_)
    return normalize_text(out)


def _where_it_has(value: Column, needed: str, pattern: str, with_: str) -> Column:
    return once(value, lambda text: F.when(text.contains(needed), F.regexp_replace(text, pattern, with_)).otherwise(text))


def decoded(value: Column) -> Column:
    """The character references that titles have, decoded; others stay."""
    out = text_of(value)
    for name, mark in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.regexp_replace(out, f"&{name};?", mark)
    return out
