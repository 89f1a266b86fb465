"""Columns of text: normalisation, splitting, cutting, prefixes, lexical tokens, parsing of generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind; Java's \s alone is ASCII.
SPACE = r"[\s\p{Z}]+"
#: The same, but for single spaces, which need no replacing.
_UNEVEN = r" [\s\p{Z}]+|[\s\p{Z}&&[^ ]][\s\p{Z}]*"
PARAGRAPH, LINE = r"\n\s*\n", r"\n"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
QUERY, PASSAGE = "[QUERY] ", "[PASSAGE] "


def collapse(c: Column) -> Column:
    """White space of any kind as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, _UNEVEN, " "))


def normalise_runs(c: Column) -> Column:
    """Near-duplicate key, first mode: collapsed, lower case, each run of digits as one #, only word characters, white space and # kept."""
    return runs_of_collapsed(collapse(c))


def runs_of_collapsed(c: Column) -> Column:
    """`normalise_runs` of a text that is collapsed already."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "#"), r"[^\p{L}\p{N}_\s#]+", "")


def normalise_digits(c: Column) -> Column:
    """Near-duplicate key, second mode: letters, digits and spaces only, collapsed after the dropping, each digit as #, lower case."""
    kept = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{Nd}\s]+", ""), r"\s+", " ")
    return F.lower(F.regexp_replace(F.trim(kept), r"\p{Nd}", "#"))


def pieces(c: Column, size: int = 50_000) -> Column:
    """Fixed pieces of `size` characters, without loss; an empty text is one empty piece."""
    last = F.greatest(F.ceil(F.length(c) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def truncate_bytes(c: Column, size: int) -> Column:
    """The longest prefix of whole characters that has at most `size` bytes in UTF-8."""
    head = F.substring(c, 1, size)  # at most `size` characters can fit
    fits = F.transform(F.sequence(F.lit(0), F.length(head)), lambda n: F.when(F.octet_length(F.substring(head, F.lit(1), n)) <= size, n))
    return F.when(F.octet_length(c) <= size, c).otherwise(F.substring(head, F.lit(1), F.array_max(fits)))


def until_quote(c: Column) -> Column:
    """What stands before the first quote that no odd run of backslashes precedes."""
    return F.regexp_extract(c, r'^((?:[^"\\]|\\.)*)', 1)


def unescape(c: Column) -> Column:
    """A fragment of a JSON string, unescaped; at each edge 0 to 2 characters are given up if it can't be read as it is. Null if nothing helps."""
    tries = [F.from_json(F.concat(F.lit('["'), F.substring(c, F.lit(a + 1), F.length(c) - a - b), F.lit('"]')), "array<string>")[0] for a in range(3) for b in range(3)]
    return F.coalesce(*tries)


def without_controls(c: Column) -> Column:
    """Without C0, C1 and DEL; tabs, line feeds and carriage returns stay."""
    return F.regexp_replace(c, CONTROL, "")


def torn(c: Column) -> Column:
    """Whether escapes stand in the text as two characters, or characters were lost."""
    return c.rlike(r'\\[nrtu"]') | c.contains("�")


def snap_head(c: Column, within: int = 40) -> Column:
    """Drops the start up to the first space if that is among the first `within` characters."""
    at = F.instr(c, " ")
    return F.when((at > 0) & (at <= within), F.substring(c, at + 1, F.length(c))).otherwise(c)


def snap_tail(c: Column, within: int = 40) -> Column:
    """Drops the end from the last space on if that is among the last `within` characters."""
    at = F.instr(F.reverse(c), " ")
    return F.when((at > 0) & (at <= within), F.substring(c, F.lit(1), F.length(c) - at)).otherwise(c)


def query_text(c: Column) -> Column:
    return F.concat(F.lit(QUERY), collapse(c))


def passage_text(c: Column) -> Column:
    return F.concat(F.lit(PASSAGE), collapse(c))


def without_prefixes(c: Column) -> Column:
    """All occurrences of the two prefixes dropped; an empty rest is null."""
    return F.nullif(F.replace(F.replace(c, F.lit(QUERY), F.lit("")), F.lit(PASSAGE), F.lit("")), F.lit(""))


def question_of(c: Column) -> Column:
    """A highlighting prompt without its lead-in."""
    return F.trim(F.regexp_replace(c, r"(?s)^Highlight the parts.*?Details:\s*", ""))


def context_of(c: Column) -> Column:
    """What stands between 'Context:' and the line of the question."""
    return F.trim(F.regexp_extract(c, r"(?s)Context:(.*?)\nQuestion:", 1))


def first_answer_line(c: Column) -> Column:
    """A generated query: trimmed, without quotes and lead-in, first line only."""
    bare = F.regexp_replace(F.trim(c), r"^[\"'“”]+|[\"'“”]+$", "")
    return F.trim(F.split(F.regexp_replace(bare, r"(?i)^(query|question|search)\s*[:\-]\s*", ""), "\n")[0])


def lexical_tokens(c: Column) -> Column:
    """Lower case, cut at everything but letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def marked_tokens(c: Column, start: str = "[CLS]", end: str = "[SEP]") -> Column:
    """Lexical tokens between two marks, in the place of a subword tokenizer's template."""
    return F.concat(F.array(F.lit(start)), lexical_tokens(c), F.array(F.lit(end)))


def space_tokens(c: Column) -> Column:
    """Lower case, cut at white space."""
    return F.filter(F.split(F.lower(c), SPACE), lambda w: w != "")


def head_key(c: Column, size: int = 512) -> Column:
    """A key of the first `size` characters."""
    return F.md5(F.substring(c, 1, size))


def slug(*parts: Column) -> Column:
    return F.concat_ws("-", F.lit("synth"), *(F.lower(F.split(p, " ")[0]) for p in parts))


def model_name(c: Column) -> Column:
    """The last segment of a path."""
    return F.substring_index(c, "/", -1)


def progress_bar(share: Column, width: int = 20) -> Column:
    full = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def pick(options: list[str], *key: Column) -> Column:
    """One of the options, by hash of the key."""
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(*key), F.lit(len(options))).cast("int") + 1)


def weighted_pick(first: list[str], share: float, others: list[str], seed: int, *key: Column) -> Column:
    """One of the first options with a chance of `share`, else one of the others, by hash of seed and key."""
    h = lambda name, n: F.pmod(F.conv(F.substring(order_key(seed, F.lit(name), *key), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    of = lambda options, name: F.element_at(F.array(*map(F.lit, options)), (h(name, len(options)) + 1).cast("int"))
    return F.when(h("which", 1000) < round(1000 * share), of(first, "first")).otherwise(of(others, "other"))


def order_key(seed: int, *cols: Column) -> Column:
    """A place in a seeded order that is the same in every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def commas(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)


def term_hits(c: Column, terms: list[str]) -> Column:
    """All occurrences of some terms, the longest first where several fit, whatever the case; a term counts only as whole words."""
    alternatives = "|".join(r"\Q" + t + r"\E" for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])"), F.lit(0)), lambda x: F.lower(x))
