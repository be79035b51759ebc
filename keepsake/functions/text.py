"""Token, edit, document and path functions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .numbers import let, ratio

# The word lists below must hold exactly these entries for results to agree.
DOMAIN_TERMS = [
    "roof", "roofing", "electrical", "plumbing", "hvac", "framing", "drywall", "flooring",
    "concrete", "foundation", "insulation", "wiring", "pipes", "ductwork", "shingles", "siding",
    "windows", "doors", "fixtures", "installation", "repair", "inspection", "progress", "completion",
]
JARGON = ["api", "endpoint", "implementation", "function", "method", "interface"]
CONTEXT_TERMS = ["specifically", "for example", "such as", "including"]
CASUAL_WORDS = ["hey", "yeah", "stuff", "things", "got"]
FORMAL_WORDS = ["greetings", "indeed", "items", "elements", "obtained"]
PROHIBITED_TERMS = ["ignore previous", "disregard instructions", "pretend you are", "act as if",
                    "bypass", "hack"]
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
             "css": "css", "scss": "scss", "html": "html", "json": "json", "md": "markdown"}
TOPICS = [("performance", ["performance", "optimization"]),
          ("testing", ["testing", "development"]),
          ("architecture", ["architecture", "system"]),
          ("data", ["data", "algorithm"])]
DOMAIN_BOOST = 0.3


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_of(conditions) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def labels(*pairs) -> Column:
    """Array of the labels whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]),
                    lambda x: x.isNotNull())


def tokens(text: Column, min_len: int = 3) -> Column:
    """Distinct lower-case ASCII words of at least ``min_len`` characters."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_]+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= min_len))


def words(text: Column, min_len: int = 4) -> Column:
    """Distinct lower-case words split on single spaces only."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), " ")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= min_len))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), empty=0.0)


def set_jaccard(a: Column, b: Column) -> Column:
    """The same for arrays without repeats: the union follows from the sizes."""
    total = F.size(a) + F.size(b)
    return let(F.size(F.array_intersect(a, b)), lambda n: ratio(n, total - n, empty=0.0))


def domain_terms(toks: Column) -> Column:
    return F.array_intersect(toks, strings(DOMAIN_TERMS))


def token_similarity(t1: Column, t2: Column, d1: Column | None = None, d2: Column | None = None) -> Column:
    """Jaccard plus a boost for shared domain terms, at most one. Inputs are token sets, and their
    domain terms where these are already known."""
    d1 = domain_terms(t1) if d1 is None else d1
    d2 = domain_terms(t2) if d2 is None else d2
    return boosted(set_jaccard(t1, t2), d1, d2)


def counted_jaccard(shared: Column, size1: Column, size2: Column) -> Column:
    """:func:`set_jaccard` from the number of shared items and the sizes."""
    return ratio(shared, size1 + size2 - shared, empty=0.0)


def boosted(base: Column, d1: Column, d2: Column) -> Column:
    boost = ratio(F.size(F.array_intersect(d1, d2)), F.greatest(F.size(d1), F.size(d2)), empty=0.0)
    return F.least(F.lit(1.0), base + boost * F.lit(DOMAIN_BOOST))


def description_similarity(text1: Column, text2: Column) -> Column:
    missing = (F.coalesce(F.length(text1), F.lit(0)) == 0) | (F.coalesce(F.length(text2), F.lit(0)) == 0)
    # each text is split once, however often the formula names its tokens
    sets = F.struct(tokens(text1).alias("t1"), tokens(text2).alias("t2"))
    similarity = let(sets, lambda s: let(F.struct(s["t1"].alias("t1"), s["t2"].alias("t2"), domain_terms(s["t1"]).alias("d1"), domain_terms(s["t2"]).alias("d2")),
                                         lambda p: token_similarity(p["t1"], p["t2"], p["d1"], p["d2"])))
    return F.when(missing, F.lit(0.0)).otherwise(similarity)


def edit_patterns(original: Column, edited: Column) -> Column:
    """Labels of what an edit did: length, jargon, context words, tone."""
    before = F.split(F.lower(original), r"\s+")
    after = F.split(F.lower(edited), r"\s+")

    def count_new(vocabulary):
        # only whole words count, so the two-word entries of a vocabulary never match
        return F.size(F.array_intersect(F.array_except(after, before), strings(vocabulary)))

    n1, n2 = F.length(original), F.length(edited)
    removed = F.size(F.array_intersect(F.array_except(before, after), strings(JARGON)))
    casual, formal = count_new(CASUAL_WORDS), count_new(FORMAL_WORDS)
    return labels((n2 < n1 * F.lit(0.7), "shortened response"),
                  (n2 > n1 * F.lit(1.3), "expanded response"),
                  (removed > 0, "removed technical jargon"),
                  (count_new(CONTEXT_TERMS) > 0, "added specific examples"),
                  (casual > formal, "made more conversational"),
                  (formal > casual, "made more formal"))


def reading_minutes(text: Column, words_per_minute: int = 200) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    n = F.size(F.split(trimmed, r"\s+"))
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n / F.lit(float(words_per_minute))))


FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)"


def front_matter(text: Column) -> Column:
    """Header block as ``map<string,string>``; empty map without one. Values lose outer quotes."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    known = strings(["title", "author", "date", "description", "heroImage", "tags"])
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entries = F.transform(lines, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"),
        F.regexp_replace(F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))),
                         r"^['\"]|['\"]$", "").alias("value")))
    entries = F.filter(entries, lambda e: F.array_contains(known, e["key"]))
    # a repeated key keeps its last value
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, values)


def front_matter_body(text: Column) -> Column:
    """The text after its header block, or all of it."""
    return F.when(text.rlike(FRONT_MATTER), F.regexp_extract(text, FRONT_MATTER, 2)).otherwise(text)


def front_matter_tags(header: Column) -> Column:
    """The trimmed tags of a header block; null without any."""
    return F.transform(F.split(header["tags"], ","), lambda x: F.trim(x))


def without_first(x: Column, part: str) -> Column:
    """``x`` without the first ``part`` in it."""
    at = F.locate(part, x)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + len(part), F.length(x)))).otherwise(x)


def _first_line(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def heading_metadata(text: Column, fallback_title: Column, default_author: str = "unknown",
                     default_date: str = "", default_description: str = "", limit: int = 150) -> Column:
    """Title, author, date and description read from the headings of a document without a header."""
    lines = F.split(text, "\n")
    heading = _first_line(lines, lambda x: x.startswith("# "))
    title = F.coalesce(F.trim(F.substring(heading, F.lit(3), F.length(heading))), fallback_title)
    byline = _first_line(lines, lambda x: x.startswith("*") & x.contains("•"))
    parts = F.transform(F.split(F.regexp_replace(byline, r"\*", ""), "•"), lambda x: F.trim(x))
    name = F.get(parts, F.lit(0))
    author = F.when(name.contains("by "), F.trim(without_first(without_first(name, "Published by "), "by "))).otherwise(
        F.lit(default_author))
    date = F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit(default_date))
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).contains("## overview")), F.lit(True))
    rest = F.slice(lines, (at + 1).cast("int"), F.size(lines))
    plain = _first_line(rest, lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#")
                        & ~x.startswith("*") & ~x.startswith("-"))
    description = F.coalesce(F.trim(plain), F.lit(default_description))
    short = F.when(F.length(description) > limit, F.concat(
        F.substring(description, F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(description)
    return F.struct(title.alias("title"), F.coalesce(author, F.lit(default_author)).alias("author"),
                    date.alias("date"), short.alias("description"))


def document_metadata(text: Column, fallback_title: Column, **defaults) -> Column:
    """What the headings say, overridden by the header block, with tags and reading minutes."""
    header, found = front_matter(text), heading_metadata(text, fallback_title, **defaults)
    own = lambda key: F.coalesce(header[key], found[key]).alias(key)
    return F.struct(own("title"), own("author"), own("date"), own("description"), front_matter_tags(header).alias("tags"),
                    header["heroImage"].alias("heroImage"), reading_minutes(text).alias("minutes"))


def heading_summary(text: Column, fallback_title: Column, fallback_description: Column,
                    limit: int = 160) -> Column:
    """Title and first paragraph after it, cut to ``limit`` characters including the dots."""
    lines = F.split(text, "\n")
    heading = _first_line(lines, lambda x: x.rlike(r"^#\s+.+$"))
    title = F.coalesce(F.regexp_extract(heading, r"^#\s+(.+)$", 1), fallback_title)
    at = F.array_position(F.transform(lines, lambda x: x.startswith("# ")), F.lit(True))
    rest = F.slice(lines, (at + 1).cast("int"), F.size(lines))
    plain = F.when(at > 0, _first_line(rest, lambda x: (F.length(F.trim(x)) > 0)
                                       & ~x.startswith("*") & ~x.startswith("#")))
    description = F.coalesce(F.trim(plain), fallback_description)
    short = F.when(F.length(description) > limit, F.concat(
        F.substring(description, F.lit(1), F.lit(limit - 3)), F.lit("..."))).otherwise(description)
    return F.struct(title.alias("title"), short.alias("description"))


def file_extension(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -1))).otherwise(F.lit(""))


# Ordered rules: the first category whose path fragment, extension or extra test matches.
FILE_RULES = [
    ("test", ["test", "spec"], []),
    ("component", ["component"], []),
    ("api", ["api/", "/api", "endpoint"], []),
    ("util", ["util", "helper", "lib/"], []),
    ("style", [], ["css", "scss", "sass", "less", "styl"]),
    ("script", ["script"], ["sh", "bash", "zsh"]),
    ("documentation", ["readme"], ["md", "txt", "rst", "doc"]),
    ("config", ["config"], ["json", "yml", "yaml", "toml", "ini", "env"]),
    ("asset", [], ["png", "jpg", "jpeg", "gif", "svg", "ico", "webp"]),
]


def file_category(path: Column) -> Column:
    low, ext = F.lower(path), file_extension(path)
    extra = {"component": (ext == "tsx") & ~low.contains("page"), "config": path.startswith(".")}
    out = None
    for name, fragments, extensions in FILE_RULES:
        tests = [low.contains(f) for f in fragments]
        if extensions:
            tests.append(ext.isin(extensions))
        if name in extra:
            tests.append(extra[name])
        cond = any_of(tests)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("other"))


def file_language(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in LANGUAGES.items() for x in item])
    return F.coalesce(table[ext], ext)


def keyword_topic(text: Column, default: str = "abstract") -> Column:
    low = F.lower(text)
    out = None
    for topic, keywords in TOPICS:
        cond = any_of([low.contains(k) for k in keywords])
        out = F.when(cond, F.lit(topic)) if out is None else out.when(cond, F.lit(topic))
    return out.otherwise(F.lit(default))


def prohibited_terms(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(strings(PROHIBITED_TERMS), lambda t: F.contains(low, t))


def contains_all_boundaries(text: Column, boundaries: Column) -> Column:
    low = F.lower(text)
    return F.forall(boundaries, lambda b: F.contains(low, F.lower(b)))


def label_text(detected: Column, entities: Column, label_min: float = 0.6,
               entity_min: float = 0.2) -> Column:
    """Join label and entity descriptions above their score limits; each distinct text once."""
    def names(items, limit):
        kept = F.filter(items, lambda x: x["description"].isNotNull() & (F.length(x["description"]) > 0)
                        & (F.coalesce(x["score"], F.lit(0.0)) > limit))
        return F.transform(kept, lambda x: x["description"])
    return F.array_join(F.array_union(names(detected, label_min), names(entities, entity_min)), ", ")


def ai_tag_id(photo_id: Column, tag: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(tag, r"\s+", "_"), r"[^a-zA-Z0-9_]", "")
    return F.concat(F.lit("ai_"), photo_id.cast("string"), F.lit("_"), slug)
