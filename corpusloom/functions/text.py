"""String rules as column expressions: Unicode-aware, code-point based, inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks and words that the rules go by.
TERMINAL_MARKS = "。！？；：，、）)]】》」』…\"'"
HEADING = r"(?U)^(?:#{1,6}\s|[一二三四五六七八九十百]+、)"
META_FIELD = r"(?U)^(?:备注|更新时间|免责声明|日期|版本|作者|编号|文档名称)\s*[：:]"
CJK = "一-鿿"
DROPPED_MARKS = "，。！？；：、·…—“”‘’（）()【】[]{}《》〈〉「」『』\"'`~～,;:!?./|\\-_*•"
QUERY_END_MARKS = "？?。！!，,、；;：:"
DEICTIC_WORDS = (
    "这个", "那个", "这些", "那些", "这里", "那里", "这儿", "那儿", "它", "他", "她", "他们", "她们", "它们", "其",
    "上面", "前面", "之前", "刚才", "上述", "以上", "后者", "前者", "另外", "其他", "其它",
)
DEICTIC_STARTS = ("那", "这")
TYPOS = {"7夭": "7天", "退挨货": "退换货", "联纱": "联系", "中习会": "系统会", "进渡": "进度"}
PRICE_PER_1000 = {"prompt": 0.00027, "completion": 0.00110}


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(line: Column) -> Column:
    return strip(line) == ""


def is_table_row(line: Column) -> Column:
    return strip(line).startswith("|")


def is_heading(line: Column, pattern: str = HEADING) -> Column:
    return strip(line).rlike(pattern)


def is_list_item(line: Column) -> Column:
    return strip(line).startswith("- ")


def is_special(line: Column, heading: str = HEADING) -> Column:
    """Lines that stand for themselves: blank, heading, table row, list item or a field of the document's head."""
    return is_blank(line) | is_heading(line, heading) | is_table_row(line) | is_list_item(line) | strip(line).rlike(META_FIELD)


def ends_terminal(line: Column, marks: str = TERMINAL_MARKS) -> Column:
    """Whether the last character is one of ``marks``."""
    return (line != "") & F.contains(F.lit(marks), F.right(line, F.lit(1)))


def close_spaces(line: Column) -> Column:
    """Drop blanks between CJK characters, and between these and digits."""
    for left, right in ((CJK, CJK), (CJK, "0-9"), ("0-9", CJK)):
        line = F.regexp_replace(line, f"(?<=[{left}])[ \\t]+(?=[{right}])", "")
    return line


def fix_typos(line: Column, typos: dict[str, str] = TYPOS) -> Column:
    """Replace each wrong form by its right one, in order."""
    for wrong, right in typos.items():
        line = F.replace(line, F.lit(wrong), F.lit(right))
    return line


def count_typos(line: Column, typos: dict[str, str] = TYPOS) -> Column:
    """Wrong forms that ``fix_typos`` will replace, each counted when its turn comes."""
    total = F.lit(0)
    for wrong, right in typos.items():
        total = total + ((F.char_length(line) - F.char_length(F.replace(line, F.lit(wrong), F.lit("")))) / len(wrong)).cast("int")
        line = F.replace(line, F.lit(wrong), F.lit(right))
    return total.cast("long")


def normalize_cell(cell: Column) -> Column:
    """A table cell with days written one way and single blanks."""
    cell = F.regexp_replace(strip(cell), r"(?U)(\d+)\s*日", "$1天")
    return F.regexp_replace(F.regexp_replace(cell, r"(?U)(\d+)\s+天", "$1天"), r"(?U)\s+", " ")


def _normal_forms(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts of ASCII alone are in normal form; the others are made one at a time."""
    for texts in parts:
        wide = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
        made = pa.array((unicodedata.normalize("NFKC", t.as_py()) for t in texts.filter(wide)), texts.type)
        yield pc.replace_with_mask(texts, wide, made)


@F.arrow_udf(T.StringType())
def nfkc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility normal form, which Spark has no function for."""
    yield from _normal_forms(parts)


def normalize_unit(text: Column) -> Column:
    """The key of units that differ in width, marks, blanks or case only."""
    return F.lower(F.regexp_replace(F.translate(nfkc(text), DROPPED_MARKS, ""), r"(?U)\s+", ""))


def bigrams(text: Column) -> Column:
    """Distinct character pairs; of one character, that character; of none, nothing."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of bigrams; of empty sets, 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def split_sentences(text: Column, marks: str = "。！？；") -> Column:
    """Sentences with their end marks, stripped, without empty ones."""
    pieces = F.split(text, f"(?<=[{marks}])")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def normalize_query(question: Column) -> Column:
    """A question in lower case, with single blanks and without marks at its end."""
    text = F.regexp_replace(F.lower(strip(question)), r"(?U)\s+", " ")
    return F.rtrim(text, F.lit(QUERY_END_MARKS))


def cache_key(question: Column, fingerprint: Column) -> Column:
    """The key of an answer: corpus fingerprint and question, so that a new corpus misses."""
    return F.concat(F.lit("rag:cache:answer:"), F.left(fingerprint, F.lit(12)), F.lit(":"), F.sha1(normalize_query(question)))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of ``words`` occurs in the text."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def has_reference(question: Column, words: Sequence[str] = DEICTIC_WORDS, starts: Sequence[str] = DEICTIC_STARTS, short: int = 8) -> Column:
    """Whether a question leans on what was said before. A null question leans on nothing."""
    text = F.coalesce(strip(question), F.lit(""))
    begins = F.left(text, F.lit(1)).isin(*starts) if starts else F.lit(False)
    return (text != "") & (contains_any(text, words) | ((F.char_length(text) <= short) & begins))


def json_body(text: Column) -> Column:
    """The JSON object in a model's answer, fences and chatter cut off; null if there is none."""
    bare = F.regexp_replace(text, r"(?s)```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def snippet(text: Column, size: int = 120) -> Column:
    """The start of a text on one line."""
    return F.left(F.replace(strip(text), F.lit("\n"), F.lit(" ")), F.lit(size))


def overlap_share(chunk_start: Column, chunk_end: Column, start: Column, end: Column) -> Column:
    """The part of [start, end) that a chunk covers."""
    return F.greatest(F.lit(0), F.least(chunk_end, end) - F.greatest(chunk_start, start)) / F.greatest(F.lit(1), end - start)


def http_error_kind(status: Column) -> Column:
    """The kind of a failed call by its status."""
    return F.when(status.isin(401, 403), "auth").when(status == 429, "rate_limit").when(status >= 500, "server").otherwise("bad_request")


def cost(prompt: Column, completion: Column) -> Column:
    """Price of a call in dollars."""
    return F.round((prompt * PRICE_PER_1000["prompt"] + completion * PRICE_PER_1000["completion"]) / 1000, 6)


def stable_hash(text: Column, seed: int) -> Column:
    """A hash that every machine agrees on."""
    return F.crc32(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
