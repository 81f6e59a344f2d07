"""Text expressions: Column -> Column, no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(s: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, upper case. Null stays null."""
    return F.upper(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def squeeze_text(s: Column) -> Column:
    """All white space removed, upper case."""
    return F.upper(F.regexp_replace(s, r"(?U)\s+", ""))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longer)


def fuzzy_match(a: Column, b: Column, most: float = 0.20) -> Column:
    return edit_ratio(a, b) <= most


def language_by_script(s: Column) -> Column:
    """Hangul before kana and Han before Cyrillic, else English."""
    return F.when(s.rlike("[가-힣]"), "ko").when(s.rlike("[぀-ヿ一-鿿]"), "ja").when(s.rlike("[Ѐ-ӿ]"), "ru").otherwise("en")


def clean_html(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))


def keyword_hits(s: Column, keywords: list[str]) -> Column:
    """The keywords that stand anywhere in the squeezed text; nested ones all count."""
    text = squeeze_text(s)
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, F.upper(F.regexp_replace(k, " ", ""))))


def titleblock_decision(hits: Column, density: Column, least_hits: int = 2, least_density: float = 0.05) -> Column:
    return F.when(hits >= least_hits, "stage1_titleblock").when((hits == 0) & (density < least_density), "stage2_no_titleblock").otherwise("manual_review")


# Patterns of dimensions and of roughness.
DIMENSIONS = [
    r"[Ø⌀φ]\s*\d+(?:\.\d+)?",
    r"\bR\s*\d+(?:\.\d+)?",
    r"\bM\s*\d+(?:\.\d+)?",
    r"±\s*\d+(?:\.\d+)?",
    r"\d+(?:\.\d+)?\s*[°]",
    r"\d+(?:\.\d+)?\s*(?:mm|MM|μm|um)",
    r"\d+(?:\.\d+)?\s*[+\-]\s*0?\.\d+",
    r"\d+\s*[xX×]\s*[Ø⌀]",
]
ROUGHNESS = [r"\bRa\s*\d+(?:\.\d+)?", r"\bRz\s*\d+(?:\.\d+)?", r"\bRmax\s*\d+(?:\.\d+)?"]


def pattern_count(s: Column, patterns: list[str]) -> Column:
    """Matches of all patterns; what several match counts for each. Null text: 0."""
    return F.coalesce(reduce(lambda a, b: a + b, (F.regexp_count(s, F.lit(p)) for p in patterns)), F.lit(0))


def drawing_type(dims: Column, balloons: Column, bom: Column, dims_made: int = 5, balloons_assembly: int = 10, balloons_made: int = 5, dims_assembly: int = 5) -> Column:
    assembly = bom | ((balloons >= balloons_assembly) & (dims < dims_assembly))
    return F.when(assembly, "assembly").when((dims >= dims_made) & (balloons < balloons_made), "manufacturing").otherwise("manual_review_type")


def type_by_counts(pmi: Column, iso: Column, table: Column, made: int = 5, views: int = 1, tables: int = 1) -> Column:
    return F.when(pmi >= made, "manufacturing").when((iso >= views) | (table >= tables), "assembly").otherwise("manual_review_type")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r".\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _before(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def group_key_pmi(path: Column) -> Column:
    return _before(_before(stem(path), "__PMI_"), ".rf.")


def group_key_patch(path: Column, marks: tuple[str, ...] = ("__View_", "__TitleBlock_", "__Notes_", "__Measure_", "__GDT_", "__Roughness_")) -> Column:
    """Cut at ``.rf.``, then at the first mark in list order that is there."""
    base = _before(stem(path), ".rf.")
    return reduce(lambda rest, m: F.when(F.contains(base, F.lit(m)), _before(base, m)).otherwise(rest), reversed(marks), base)


def group_key_plain(path: Column) -> Column:
    return _before(stem(path), ".rf.")


def file_extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def split_notes(s: Column) -> Column:
    """Numbered items if there are two at least, else parts between line ends, full stops and semicolons."""
    numbered = F.regexp_extract_all(s, F.lit(r"(?:^|\s)(\d+\s*[\.\)]\s*[^.\n]+)"), F.lit(1))
    parts = F.filter(F.transform(F.split(s, r"[\n\.;]+"), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(F.size(numbered) >= 2, F.transform(numbered, lambda x: F.trim(x))).otherwise(parts)


def bullet_items(s: Column) -> Column:
    """Lines without leading bullets or numbers, blank ones dropped."""
    return F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda p: p != "")


# Words of parts lists, languages by the start of a file name, marks of an assistant's answer.
PARTS_LIST = [
    "PART NO", "PART NUMBER", "ITEM", "QTY", "QUANTITY", "B.O.M", "BILL OF MATERIAL", "BILL OF MATERIALS",
    "품번", "품명", "수량", "부품번호", "자재명",
    "部品番号", "品番", "数量", "員数", "名称",
    "ПОЗ", "КОЛ", "НАИМЕНОВАНИЕ", "ОБОЗН",
    "序号", "序號", "數量", "名稱", "零件号", "零件號", "件数", "件數", "材料", "規格",
]
PREFIXES = {"en_": "English", "ja_": "Japanese", "ko_": "Korean", "ru_": "Russian", "zh_": "Chinese", "de_": "German"}
ANSWERS = [r"(?s)[Aa]ssistant\s*:\s*(.+)$", r"(?s)<\|assistant\|>(.+?)(?:<\|.+?\|>|$)", r"(?s)<assistant>(.+?)</assistant>"]


def parts_list_hits(s: Column, keywords: list[str] = PARTS_LIST) -> Column:
    """How many different keywords stand in a text, in any case, runs of blanks as one; null: 0."""
    plain = F.regexp_replace(F.upper(F.trim(F.coalesce(s, F.lit("")))), r"(?U)\s+", " ")
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(plain, F.upper(k))))


def language_by_prefix(name: Column) -> Column:
    """Language by the start of a file name, in any case; else ``Unknown``."""
    return F.coalesce(*(F.when(F.lower(name).startswith(p), language) for p, language in PREFIXES.items()), F.lit("Unknown"))


def note_lines(raw: Column) -> Column:
    """Lines of a text that are not blank, trimmed; null: none."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def assistant_answer(s: Column) -> Column:
    """An assistant's part of a chat transcript, trimmed: by the first mark that is found, else after the bare word, else all."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    marked = [F.when(s.rlike(p), trimmed(F.regexp_extract(s, p, 1))) for p in ANSWERS]
    bare = F.when(s.contains("Assistant"), trimmed(F.regexp_extract(s, r"(?s)Assistant:*(.*)$", 1)))
    return F.coalesce(*marked, bare, trimmed(s))
