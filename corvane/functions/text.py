"""Text functions as native column expressions.

Words are runs of ``[\\p{L}\\p{N}_]``; Java's own ``\\w`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"([\p{L}\p{N}_]+)"

# The stop words of query terms.
STOP_WORDS = (
    "a about above across after against all along among an and any are around as at be been before behind below between "
    "beyond but by can could did do does doing during for from had has have how i if in into is it its just me my near no "
    "not of off on onto or our out over please show since so some than that the their them then there these they this "
    "those through to too toward under until up upon us via was we were what when where which while who whom why will "
    "with within without would you your"
).split()
# Suffixes of the light stem with what replaces them.
SUFFIXES = [("ied", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")]
# Header marks of machine-written files.
GENERATED_MARKERS = ["@generated", "do not edit", "autogenerated", "auto-generated"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def body(text: Column) -> Column:
    """The text after its first line, or all of a text of one line."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)


def content_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"[\\/]"), -1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def stem_of(name: Column) -> Column:
    """A file name without its last extension; a leading dot starts none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last extension without its dot, empty if there is none."""
    return F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1)


def name_words(path: Column) -> Column:
    spaced = F.regexp_replace(stem_of(base_name(path)), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(spaced, r"[_\-.]+", " ")))


def search_text(path: Column, text: Column) -> Column:
    return F.concat(name_words(path), F.lit("\n"), text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def full_text_terms(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), " ")


def query_terms(text: Column) -> Column:
    """Lower-case words of three letters or more without stop words; repeats stay."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def stem(word: Column) -> Column:
    """The first suffix that leaves three letters or more is replaced."""
    out = word
    for suffix, new in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.length(word) >= len(suffix) + 3)
        out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(new))).otherwise(out)
    return out


def term_coverage(terms: Column, text: Column) -> Column:
    """The share of ``terms`` whose stem is that of a word of ``text``; 0 without terms."""

    def share(present: Column) -> Column:
        return F.size(F.filter(terms, lambda t: F.array_contains(present, stem(t)))) / F.size(terms)

    bound = F.transform(F.array(F.array_distinct(F.transform(words(text), stem))), share)[0]
    return F.when(F.size(terms) > 0, bound).otherwise(F.lit(0.0))


def _same_word(a: Column, b: Column) -> Column:
    singular = lambda w: F.regexp_replace(w, "s$", "")
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (singular(a) == singular(b)))


def name_exact(path: Column, query: Column) -> Column:
    name, q = file_name(path), F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return (q != "") & ((q == name) | (q == stem_of(name)))


def name_share(path: Column, query: Column) -> Column:
    """The share of query terms, the file's extension left out, that are words of its name; 1 for an exact name."""
    ext = extension(file_name(path))
    terms = F.filter(query_terms(query), lambda t: t != ext)
    tokens = F.split(name_words(path), r"\s+")
    hits = F.size(F.filter(terms, lambda t: F.exists(tokens, lambda w: _same_word(t, w))))
    return F.when(name_exact(path, query), F.lit(1.0)).when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def keyword_query(text: Column, most: int = 200) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9+#]{3,})"), F.lit(1))), 1, most)


def keywords(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9+#.]{2,})"), F.lit(1)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def fit_to_budget(text: Column, tokens: Column) -> Column:
    return F.substring(text, F.lit(1), (tokens * 4).cast("int"))


def over_budget(text: Column, tokens: Column) -> Column:
    """Whether ``fit_to_budget`` cuts something off."""
    return F.length(text) > tokens * 4


def location(page: Column, start_line: Column, end_line: Column | None = None) -> Column:
    """``page n``, else ``line n`` or, with an end, ``lines n-m``; empty without either."""
    line = F.concat(F.lit("line "), start_line.cast("string")) if end_line is None else F.concat(F.lit("lines "), start_line.cast("string"), F.lit("-"), end_line.cast("string"))
    return F.when(page > 0, F.concat(F.lit("page "), page.cast("string"))).when(start_line > 0, line).otherwise("")


def reference(path: Column, page: Column, start_line: Column) -> Column:
    """``path:line``, or ``path (page n)``."""
    return F.concat(path, F.when(page > 0, F.concat(F.lit(" (page "), page.cast("string"), F.lit(")"))).when(start_line > 0, F.concat(F.lit(":"), start_line.cast("string"))).otherwise(""))


def says_little(caption: Column, text: Column) -> Column:
    """An image without a caption and with hardly any readable text."""
    return (F.coalesce(F.trim(caption), F.lit("")) == "") & low_content(text)


def low_content(text: Column, least_chars: int = 40, least_quality: float = 0.5) -> Column:
    return F.coalesce((content_chars(text) < least_chars) | (ocr_quality(text) < least_quality), F.lit(True))


def model_name(name: Column) -> Column:
    """Lower-cased, with the tag ``latest`` if the last part has none."""
    low = F.lower(F.trim(name))
    return F.when(F.element_at(F.split(low, "/"), -1).contains(":"), low).otherwise(F.concat(low, F.lit(":latest")))


def model_family(name: Column) -> Column:
    return F.regexp_replace(model_name(name), ":[^:]*$", "")


def cost(prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Of prices per million tokens; 0 for models without a price."""
    return F.coalesce((prompt_tokens * price_in + completion_tokens * price_out) / 1e6, F.lit(0.0))


def month_start(at: Column) -> Column:
    return F.date_trunc("month", at)


def fenced(text: Column, token: str) -> Column:
    """Untrusted text between two lines that no text of the prompt holds; ``fence_token`` finds one."""
    return F.concat(F.lit(f"<<<{token}\n"), text, F.lit(f"\n{token}>>>"))


def snippet(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(body(text), r"\s+", " ")), 1, 260)


def title(text: Column, path: Column) -> Column:
    """The first line with a character, trimmed, at most 120 long; else the file's name."""
    # F.trim itself would take the line's number as the characters to trim
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(lines, F.lit(1)), 1, 120), base_name(path))


def content_hash(kind: Column, symbol: Column, text: Column) -> Column:
    """Identity of a chunk's content; the path is no part of it, so a renamed file keeps its vectors."""
    return F.md5(F.concat_ws("\u0001", kind, symbol, text))


def normalise_quote(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")), r"[0-9]+", "#")


def looks_generated(text: Column, most: int = 300) -> Column:
    lines = F.split(text, "\n")
    head = F.lower(F.array_join(F.slice(lines, 1, 5), "\n"))
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | F.contains(head, F.lit(m))
    return (text != "") & (marked | (F.length(text) / F.size(lines) > most))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


#: Two letters or more between other signs, a vowel or a letter beyond ASCII among them, none twice in a row. A letter that
#: makes six tenths of a word stands twice in a row somewhere, but for words of three or five letters that have it at every other place.
PLAIN_WORD = (
    r"^[^\p{L}\p{N}]*+(?=\p{L}*(?:[aeiouyAEIOUY]|[\p{L}&&[^\x00-\x7F]]))(?!\p{L}*(\p{L})\1)"
    r"(?!(\p{L})\p{L}\2(?:\p{L}\2)?(?!\p{L}))\p{L}{2,}+[^\p{L}\p{N}]*+$"
)


def plain_word(raw: Column) -> Column:
    """Whether one look is enough to tell that ``token_kind`` is ``word``; others may be words too."""
    return raw.rlike(PLAIN_WORD)


def token_kind(raw: Column) -> Column:
    """What a run without white space is to ``ocr_quality``: junk, number or word."""
    bare = F.regexp_replace(raw, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    letters = lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")
    number = lambda w: w.rlike(r"^[0-9.,:/$€£%+\-]+$") & w.rlike("[0-9][^0-9]*[0-9]")

    def real(x: Column) -> Column:
        n = F.length(x)
        most = F.array_max(F.transform(F.array_distinct(F.split(x, "")), lambda c: n - F.length(F.replace(x, c, F.lit("")))))
        # only a letter that stands twice can make up most of a longer word
        mixed = (n < 3) | ~x.rlike(r"(?s)(.).*\1") | (most / n < 0.6)
        return (n >= 2) & x.rlike(r"[aeiouyAEIOUY]|[^\x00-\x7F]") & mixed

    plain = lambda w: w.rlike(r"^\p{L}+$")
    word = lambda w: let(F.when(plain(w), w).otherwise(letters(w)), real)
    return F.when(plain_word(raw), "word").otherwise(let(bare, lambda w: F.when(w == "", "junk").when(number(w), "number").when(word(w), "word").otherwise("junk")))


def quality_of(words: Column, junk: Column, numbers: Column) -> Column:
    return F.when(words + junk == 0, F.when(numbers > 0, 1.0).otherwise(0.0)).otherwise(words / (words + junk))


def ocr_quality(text: Column) -> Column:
    """Words over words and junk; numbers are neither. A word has two letters, a vowel and no letter that makes most of it."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    of = lambda kinds, x: F.size(F.filter(kinds, lambda k: k == x))
    return let(F.transform(tokens, token_kind), lambda k: quality_of(of(k, "word"), of(k, "junk"), of(k, "number")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def scaled_similarity(similarity: Column, floor: float) -> Column:
    if floor >= 1:
        return F.lit(0.0)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity - floor) / (1 - floor))), F.lit(0.0))


def truncate_normalise(vector: Column, dim: int) -> Column:
    """The first ``dim`` places at unit length; a zero vector stays."""

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))

    return F.transform(F.array(F.slice(vector, 1, dim)), unit)[0]
