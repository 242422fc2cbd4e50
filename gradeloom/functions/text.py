"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning for matching.
STOP_WORDS = (
    "supabase", "platform", "specialist", "overview", "management", "manage", "using", "use", "feature", "features",
    "system", "systems", "integration", "implementation", "implementing", "ability", "knowledge", "expertise", "experience",
    "application", "applications", "including", "control", "and", "for", "the", "with", "plus", "from", "into", "through",
    "about", "across", "between", "within", "without", "their", "these", "those",
)
#: The marker of cut texts, the separators of samples, and tokens allowed by role.
CUT_MARK = "\n...[truncated]"
MIDDLE_MARK, END_MARK = "\n...[middle sample]...\n", "\n...[end sample]...\n"
TOKENS_BY_ROLE = {
    "synthesizer": 700, "core architect": 800, "trainer": 1100, "student": 475, "core examiner": 375, "examiner": 425, "transfer": 600,
    "single transfer": 650, "distiller": 800,
}
OTHER_TOKENS = 550
UNICODE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(CUT_MARK))).otherwise(c)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{UNICODE_SPACE}|{UNICODE_SPACE}$", "")


def strip_reasoning(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def clean_list(items: Column) -> Column:
    """Items stripped, blank ones gone; null counts as empty."""
    stripped = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit(""))))
    return F.filter(stripped, lambda x: x != "")


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNICODE_SPACE, " "))


def normalize_task(c: Column) -> Column:
    return normalize_space(F.lower(c))


def slug(c: Column) -> Column:
    """Null where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of over two letters or digits, without stop words, singular by simple rules."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    singular = lambda w: (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(w.endswith("s") & (F.length(w) > 4) & ~w.endswith("ss"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )
    return F.array_distinct(F.transform(kept, singular))


def sample_segments(c: Column, limit: int | Column = 3000) -> Column:
    """Texts over the limit: beginning, middle and end of equal lengths with marks between them; below 300, the beginning only."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    third = F.floor((limit - len(MIDDLE_MARK) - len(END_MARK)) / 3).cast("int")
    start = F.greatest(F.lit(0), F.floor(F.length(c) / 2) - F.floor(third / 2)).cast("int") + 1
    parts = F.concat(F.substring(c, F.lit(1), third), F.lit(MIDDLE_MARK), F.substring(c, start, third), F.lit(END_MARK), F.right(c, third))
    return F.when(F.length(c) <= limit, c).when(limit < 300, F.substring(c, F.lit(1), limit)).otherwise(parts)


def bounded_sample(c: Column, limit: int = 1500) -> Column:
    return sample_segments(c, min(limit, 1500))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def expects_json(system: Column) -> Column:
    s = F.lower(system)
    return s.contains("return only") & s.contains("json")


def token_budget(role: Column, asked: Column) -> Column:
    """What a role is given of the tokens it asks for; the architect who must quote its sources is given all."""
    table = F.create_map(*[F.lit(x) for kv in TOKENS_BY_ROLE.items() for x in kv])
    return F.when(role == "architect", asked).otherwise(F.least(asked, F.coalesce(F.try_element_at(table, role), F.lit(OTHER_TOKENS))))


def retry_budget(base: Column) -> Column:
    return F.least(F.greatest(base + 256, base * 2), F.lit(1400))


def sample_budget(n_sources: Column) -> Column:
    return F.least(F.lit(3200), F.greatest(F.lit(1800), F.floor(F.lit(27000) / n_sources).cast("int")))


def weak_rubric(items: Column) -> Column:
    return F.forall(items, lambda x: F.length(x) < 18)
