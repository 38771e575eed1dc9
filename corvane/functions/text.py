"""Text functions as columns. Patterns keep to what Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.let import let

# Word lists and patterns that results depend on.
STOP_WORDS_AR = "من في على إلى عن مع هذا هذه ذلك التي الذي كان كانت إن أن لا ما هو هي وقد وكان قد لم لن أو كل بعد قبل حتى عند ومن وفي وإلى وعلى فإن فهو أيضا فقط".split()
STOP_WORDS_EN = "the a an is are was were be been being have has had do does did will would could should may might shall can to of in on at by for with from as it its this that these those and or but if then so yet not no nor only both either neither".split()
WORD = r"[\p{L}\p{N}_]+"
TECHNICAL = r"(?i)(\b(def|class|import|return|function|var|const|let|if|else|for|while|try|catch|SELECT|FROM|WHERE|JOIN|INSERT|UPDATE|DELETE|API|SDK|HTTP|JSON|XML|SQL|REST|GraphQL|algorithm|complexity|O\(n\)|theorem|lemma|proof|equation|formula|integral|derivative)\b|[{}<>\[\]();=+\-*/\\]|\b\d+\.\d+\b)"
ARABIC_LONG = r"[\x{0600}-\x{06FF}]{7,}"
NOISE = r"^(\s*|[.\-_*]{5,}|\s*(page|صفحة)\s*\d+\s*)$"
HALLUCINATION = r"(?i)\b(as of my knowledge cutoff|i cannot verify|i don't actually know|i'm making this up|i don't have access to|this is fictional|i am hallucinating|fabricated|invented fact)\b"
LEAKAGE = {
    "card": r"\b\d{16}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9_]{2,}\b",
    "credential": r"(?i)(?:password|passwd|secret|api_key)\s*[=:]\s*\S+",
    "bearer": r"Bearer\s+[A-Za-z0-9\-._~+/]+=*",
}
INJECTION = r"(?i)(ignore (previous|all) instructions|disregard system prompt|you are now|pretend you are|act as if|jailbreak|DAN mode)"
SCRIPTS = {
    "arabic": r"[\x{0600}-\x{06FF}]",
    "chinese": r"[\x{4E00}-\x{9FFF}]",
    "japanese": r"[\x{3040}-\x{30FF}]",
    "korean": r"[\x{AC00}-\x{D7AF}]",
    "russian": r"[\x{0400}-\x{04FF}]",
    "hindi": r"[\x{0900}-\x{097F}]",
    "thai": r"[\x{0E00}-\x{0E7F}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
}


def _lit(p: str) -> Column:
    return F.lit(p)


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, _lit(pattern), _lit(by))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, _lit(pattern))


def strip(c: Column) -> Column:
    return replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return replace(c, r"\s+", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), _lit(WORD), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Whole part of 1.3 times the words."""
    return F.floor(F.size(words(c)) * 1.3).cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(F.lower(strip(collapse(c))), 256)


def prompt_hash(c: Column) -> Column:
    return F.md5(F.lower(collapse(c)))


def prefix_key(c: Column, n: int = 100) -> Column:
    return F.lower(F.substring(c, 1, n))


def document_id(source: Column, page: Column, content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(source, F.lit(":"), F.coalesce(page, F.lit("")), F.lit(":"), content), 256), 1, 16))


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct runs of k lower-cased words; one shorter run for a shorter text."""
    return let(words(F.lower(c)), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(c: Column) -> Column:
    """Pieces after a closing mark and white space, or at blank lines; blank pieces go."""
    marked = replace(replace(c, r"([.!?؟۔])\s+", "$1\x01"), r"\n\n+", "\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda x: x != "")


def delimited_sentences(c: Column) -> Column:
    """Pieces between closing marks and line feeds, which go."""
    return F.filter(F.transform(F.split(c, r"[.!?؟\n]"), strip), lambda x: x != "")


def arabic_letters(c: Column) -> Column:
    return count(c, SCRIPTS["arabic"])


def arabic_run_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0.0).otherwise(count(c, r"[\x{0600}-\x{06FF}]+") / F.length(c))


def is_arabic(c: Column, least: float = 0.3) -> Column:
    return arabic_letters(c) / F.greatest(F.length(F.replace(c, F.lit(" "), F.lit(""))), F.lit(1)) >= least


def normalise_arabic(c: Column) -> Column:
    """Chunking form: one alef, ha for ta marbuta, one ya, no diacritics."""
    c = replace(replace(replace(c, "[إأآا]", "ا"), "ة", "ه"), "[يى]", "ي")
    c = replace(c, r"[\x{064B}-\x{065F}\x{0610}-\x{061A}\x{06D6}-\x{06DC}]", "")
    return strip(replace(replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def normalise_arabic_embedding(c: Column, level: str = "standard") -> Column:
    c = replace(c, r"[\x{064B}-\x{065F}\x{0670}]", "")
    if level == "minimal":
        return c
    c = replace(replace(replace(replace(replace(c, "[أإآ]", "ا"), "ؤ", "و"), "ئ", "ي"), "ى", "ي"), "ـ", "")
    return replace(c, "ة", "ه") if level == "aggressive" else c


def fix_punctuation_spacing(c: Column) -> Column:
    return strip(replace(collapse(c), r"\s+([.,!?؟،;:])", "$1"))


def script_language(c: Column) -> Column:
    """The language of the script with most characters; english if there is none."""
    counts = [count(c, p) for p in SCRIPTS.values()]
    most = F.greatest(*counts)
    out = F.when(most == 0, "english")
    for name, n in zip(SCRIPTS, counts, strict=True):
        out = out.when(n == most, name)
    return out.otherwise("english")


def document_type(c: Column) -> Column:
    html = c.rlike(r"(?i)<(html|body|div|p|h[1-6]|ul|ol|li|table)[^>]*>")
    markdown = c.rlike(r"(?m)^#{1,6}\s") | c.contains("```") | c.rlike(r"\*\*.+?\*\*")
    arabic = arabic_letters(c) / F.greatest(F.length(c), F.lit(1)) > 0.2
    return F.when(html, "html").when(markdown, "markdown").when(arabic, "arabic").otherwise("plain_text")


def strip_markdown(c: Column) -> Column:
    for pattern, by in (
        (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", "$1"), (r"_{1,3}([^_]+)_{1,3}", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[[^\]]*\]\([^)]+\)", ""),
        (r"`([^`]+)`", "$1"), (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^>\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\n{3,}", "\n\n"),
    ):
        c = replace(c, pattern, by)
    return strip(c)


def remove_code_blocks(c: Column) -> Column:
    return replace(replace(c, r"```[\s\S]*?```", ""), r"~~~[\s\S]*?~~~", "")


def markdown_title(c: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(c, r"(?m)^# (.+)$", 1)), F.lit(""))


def density(c: Column) -> Column:
    """Information density, 0 to 1, of code marks, distinct words, word length and long Arabic words."""
    n = F.length(c)

    def of_words(w: Column) -> Column:
        total = F.greatest(F.size(w), F.lit(1))
        long = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / total
        return F.size(F.array_distinct(w)) / total * 0.3 + F.least(long / 10, F.lit(1.0)) * 0.2

    d = (
        F.least(count(c, TECHNICAL) / F.greatest(n / 100, F.lit(1.0)), F.lit(1.0)) * 0.4
        + let(tokens(c), of_words)
        + F.least(count(c, ARABIC_LONG) / F.greatest(n / 200, F.lit(1.0)), F.lit(1.0)) * 0.1
    )
    return F.when(n == 0, 0.0).otherwise(F.least(d, F.lit(1.0)))


def adaptive_target(d: Column, least: int = 100, most: int = 1500) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), (F.lit(most) - d * (most - least)).cast("int")))


def keyword_density(c: Column) -> Column:
    stop = [*STOP_WORDS_AR, *STOP_WORDS_EN]

    def share(w: Column) -> Column:
        meant = F.size(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(stop)))
        return F.when(F.size(w) == 0, 0.0).otherwise(meant / F.size(w))

    return let(tokens(c), share)


def length_score(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 50, 0.2).when(n < 100, 0.5).when(n <= 600, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 600) / 2000))


def position_score(position: Column, total: Column) -> Column:
    return F.when(total <= 1, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - F.abs(position / (total - 1) - 0.5)))


def is_noise(c: Column) -> Column:
    return strip(c).rlike(NOISE)


def leakage(c: Column) -> Column:
    """The first kind of private data found, or null."""
    out = None
    for kind, pattern in LEAKAGE.items():
        out = F.when(c.rlike(pattern), kind) if out is None else out.when(c.rlike(pattern), kind)
    return out


def hard_truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters: cut at the last blank if it is past 70 %, and marked."""
    cut = F.substring(c, 1, most - 3)
    blank = F.length(cut) - F.instr(F.reverse(cut), " ") + 1
    at = F.when((F.instr(F.reverse(cut), " ") > 0) & (blank - 1 > 0.7 * F.length(cut)), F.substring(cut, F.lit(1), blank - 1)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(at, F.lit("...")))
