"""Cleaning, derivation and text functions. All are Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions import presets as P
from loomgraph.functions.columns import (
    blank_to_null,
    contains_any,
    let,
    squeeze,
    strip,
    to_integer,
)


def clean_value(c: Column, tokens: Sequence[str] = P.NULL_TOKENS) -> Column:
    """Trimmed value, or null when it is one of the null tokens."""
    s = strip(c)
    return F.when(F.lower(s).isin(list(tokens)), None).otherwise(s)


def distinct_ignoring_case(arr: Column) -> Column:
    """First spelling of each value, in order."""
    pair = F.struct(arr.alias("vals"), F.transform(arr, F.lower).alias("low"))
    return let(
        pair,
        lambda p: F.filter(p.vals, lambda x, i: F.array_position(p.low, F.lower(x)) == i + 1),
    )


def split_multi_value(c: Column, pattern: str = P.MULTI_VALUE_PATTERN) -> Column:
    """Split a multi-value cell, trim, drop blanks, remove repeats ignoring case."""
    parts = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(distinct_ignoring_case(parts))


def parse_code(c: Column) -> Column:
    """Section, class and subclass of a classification code; null where the form does not fit."""
    return let(
        F.upper(strip(c)),
        lambda s: F.struct(
            blank_to_null(F.substring(s, 1, 1)).alias("section"),
            blank_to_null(F.regexp_extract(s, r"^([A-H]\d{2})", 1)).alias("class_code"),
            blank_to_null(F.regexp_extract(s, r"^([A-H]\d{2}[A-Z])", 1)).alias("subclass"),
        ),
    )


def code_prefixes(c: Column) -> Column:
    """Prefixes of length 1, 3 and 4 by position, without validation; '' when too short."""
    def head(n: int) -> Column:
        return F.when(F.length(c) >= n, F.substring(c, 1, n)).otherwise("")

    return F.struct(head(1).alias("section"), head(3).alias("class_code"), head(4).alias("subclass"))


def full_text(*parts: Column, kept: Sequence[Column] = ()) -> Column:
    """Parts joined by a blank: empty ones are left out, those of `kept` only when they are null."""
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts], *kept)


def safe_int(c: Column) -> Column:
    return F.coalesce(to_integer(c), F.lit(0).cast("bigint"))


def org_type(
    c: Column,
    school: Sequence[str] = P.SCHOOL_WORDS,
    research: Sequence[str] = P.RESEARCH_WORDS,
    unnamed: str = P.ORG_TYPES["other"],
) -> Column:
    """Organisation type by keyword: school, then research, else company; `unnamed` without a name."""
    low = F.lower(c)
    names = P.ORG_TYPES
    return (
        F.when(c.isNull() | (c == ""), unnamed)
        .when(contains_any(low, [w.lower() for w in school]), names["school"])
        .when(contains_any(low, [w.lower() for w in research]), names["research"])
        .otherwise(names["company"])
    )


def comparison_name(c: Column, suffixes: Sequence[str] = P.COMPARISON_SUFFIXES) -> Column:
    """Name for comparison: lower case, each suffix off in list order, no punctuation."""
    def off(s: Column, suffix: Column) -> Column:
        bare = s.substr(F.lit(1), F.length(s) - F.length(suffix))
        return F.when(F.endswith(s, suffix), strip(bare)).otherwise(s)

    s = F.aggregate(F.array(*[F.lit(x) for x in suffixes]), F.lower(c), off)
    s = F.regexp_replace(s, r"""[,.\-'"()（）\[\]【】]""", "")
    return F.coalesce(squeeze(s), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def embedding_name(c: Column, suffixes: Sequence[str] = P.EMBEDDING_SUFFIXES) -> Column:
    """Name for encoding: compatibility form, first fitting suffix off, the name itself if nothing is left."""

    def cut(s: Column) -> Column:
        low, out = F.lower(s), s
        for suffix in reversed(list(suffixes)):
            bare = strip(s.substr(F.lit(1), F.length(s) - len(suffix)))
            out = F.when(low.endswith(suffix), bare).otherwise(out)
        return squeeze(out)

    return let(cut(_nfkc(c)), lambda s: F.when(s == "", c).otherwise(s))


def is_invalid_name(c: Column) -> Column:
    """Fewer than two characters, digits only, or fewer than two meaningful characters."""
    meaningful = F.regexp_replace(c, r"(?U)[\s\d\W]", "")
    return c.isNull() | (F.length(c) < 2) | c.rlike(r"(?U)^\d+$") | (F.length(meaningful) < 2)


def entity_type(c: Column) -> Column:
    """Person for `Last, First` and for 2-4 Han characters without an organisation word."""
    han = c.rlike("^[一-龥]{2,4}$") & ~contains_any(c, P.ORG_WORDS)
    latin = c.rlike(r"^[A-Za-z\-']+,\s+[A-Za-z\s\-'.]+$")
    return F.when(latin | han, "person").otherwise("organization")


def contains_han(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def is_mostly_han(c: Column) -> Column:
    """More than a third of the characters are Han."""
    han = F.length(F.regexp_replace(c, "[^一-龥]", ""))
    return F.coalesce(han > F.length(c) / 3, F.lit(False))


def place_by_rules(c: Column) -> Column:
    """Place of a party from its name: special regions, provinces with city, foreign patterns.

    The first rule that fits gives a rule number; its place is then looked up
    in literal arrays, so each test appears once in the generated code.
    """
    conf = P.PLACE_CONFIDENCE
    rules = [(c.contains(k), P.HOME_COUNTRY, v, conf["special"], "") for k, v in P.SPECIAL_REGIONS.items()]
    for key, name in P.PROVINCES.items():
        city_key = "" if key in P.MUNICIPALITIES else key
        rules.append((c.contains(key), P.HOME_COUNTRY, name, conf["province"], city_key))
    rules += [(c.rlike("(?i)" + k), v, None, conf["foreign"], "") for k, v in P.FOREIGN_PATTERNS.items()]
    number = F.coalesce(*[F.when(rule[0], i + 1) for i, rule in enumerate(rules)])

    def column(i: int) -> Column:
        return F.array(*[F.lit(rule[i]) for rule in rules])

    def build(n: Column) -> Column:
        city_key = F.try_element_at(column(4), n)
        found = blank_to_null(F.regexp_extract(c, "([一-龥]{2,4}市)", 1))
        city = F.when((city_key != "") & ~F.contains(found, city_key), found)
        return F.when(
            n.isNotNull(),
            F.struct(
                F.try_element_at(column(1), n).alias("country"),
                F.try_element_at(column(2), n).alias("province"),
                city.alias("city"),
                F.when(city.isNotNull(), conf["city"]).otherwise(F.try_element_at(column(3), n)).alias("confidence"),
            ),
        )

    return let(number, build)


def place_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[blank_to_null(p) for p in parts])


def place_level(country: Column, province: Column, city: Column, district: Column) -> Column:
    def given(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return F.when(given(district), 4).when(given(city), 3).when(given(province), 2).when(given(country), 1).otherwise(0)


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def place_abbreviation(c: Column, length: int = 2) -> Column:
    bare = F.regexp_replace(c, "[省市区县]$", "")
    return F.coalesce(F.try_element_at(_lookup(P.PLACE_ABBREVIATIONS), bare), F.lower(F.substring(bare, 1, length)))


def place_id(country: Column, province: Column, city: Column, district: Column) -> Column:
    """Id such as `cn-gd-sz`; an unknown country is its first two letters, none is `xx`."""
    known = F.try_element_at(_lookup(P.COUNTRY_CODES), country)
    head = F.coalesce(known, F.lower(F.substring(blank_to_null(country), 1, 2)), F.lit("xx"))
    special = F.when(province.contains("香港"), "hk").when(province.contains("澳门"), "mo").when(province.contains("台湾"), "tw")
    given = blank_to_null(province)
    second = F.when(given.isNotNull(), F.coalesce(special, place_abbreviation(given)))
    return F.concat_ws("-", head, second, place_abbreviation(blank_to_null(city)), place_abbreviation(blank_to_null(district)))


def family_id(c: Column) -> Column:
    """First member of the `;` list, trimmed, 50 characters."""
    return F.substring(strip(F.split(c, ";")[0]), 1, 50)


def canonical_value(c: Column, valid: Sequence[str], words: Mapping[str, str], both_ways: bool = False) -> Column:
    """Exact member, else containment either way, else keyword; null when nothing fits."""
    out = F.lit(None).cast("string")
    for word, value in reversed(list(words.items())):
        hit = c.contains(word)
        if both_ways:
            hit = hit | F.lit(word).contains(c)
        out = F.when(hit, value).otherwise(out)
    for value in reversed(list(valid)):
        out = F.when(F.lit(value).contains(c) | c.contains(value), value).otherwise(out)
    out = F.when(c.isin(list(valid)), c).otherwise(out)
    return F.when(c.isNull() | (c == ""), None).otherwise(out)


def place_tree(located: DataFrame, order: str, home: str | None = P.HOME_COUNTRY) -> DataFrame:
    """One node per level of every place; a repeated id keeps the place seen first.

    `located(country, province, city, district, <order>)`. Levels below the
    country are built for the home country only, or for all with `home=None`.
    """
    c, p, t, d = (F.col(x) for x in ("country", "province", "city", "district"))
    none = F.lit(None).cast("string")

    def given(x: Column) -> Column:
        return F.coalesce(x, F.lit("")) != ""

    def node(level: int, name: Column, parts: list[Column], when: Column) -> Column:
        padded = parts + [none] * (4 - len(parts))
        return F.when(
            when,
            F.struct(
                place_id(*padded).alias("place_id"),
                name.alias("name"),
                F.lit(level).alias("level"),
                place_path(*parts).alias("full_path"),
                *[F.coalesce(x, F.lit("")).alias(n) for x, n in zip(padded, ("country", "province", "city", "district"))],
            ),
        )

    inside = F.lit(True) if home is None else c == home
    levels = F.array_compact(
        F.array(
            node(1, c, [c], given(c)),
            node(2, p, [c, p], given(c) & inside & given(p)),
            node(3, t, [c, p, t], given(c) & inside & given(p) & given(t)),
            node(4, d, [c, p, t, d], given(c) & inside & given(p) & given(t) & given(d)),
        )
    )
    long = located.select(F.col(order).alias("_order"), F.explode(levels).alias("n"))
    first = long.groupBy("n.place_id").agg(F.min_by("n", F.struct(F.col("_order"), F.col("n.full_path"))).alias("n"))
    parent = F.when(F.col("level") > 1, F.regexp_replace("place_id", "-[^-]*$", ""))
    return first.select("n.*").withColumn("parent_id", parent)


def topic_from_file(name: Column) -> Column:
    """Topic of an input file: exact name, then ordered parts of the name, then the root topic."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = F.lit(P.ROOT_TOPIC)
    for part, topic in reversed(P.FILE_TOPIC_PARTS):
        out = F.when(stem.contains(part), topic).otherwise(out)
    return F.coalesce(F.try_element_at(_lookup(P.FILE_TOPICS), stem), out)


def key_sentences(c: Column, n: int = 3, words: Sequence[str] = P.KEY_WORDS) -> Column:
    """The n best sentences by keyword hits, +1 in the first three, ties in text order."""
    sentences = F.filter(F.transform(F.split(c, "[。！？.!?]"), strip), lambda s: F.length(s) > 10)

    def score(s: Column, first: Column) -> Column:
        hits = F.when(F.array_contains(first, s), 1).otherwise(0)
        low = F.lower(s)
        for w in words:
            hits = hits + F.when(low.contains(w.lower()), 1).otherwise(0)
        return hits

    def best(p: Column) -> Column:
        ranked = F.transform(p.all, lambda s, i: F.struct((-score(s, p.first)).alias("a"), i.alias("b"), s.alias("s")))
        return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda r: r.s)

    chosen = let(sentences, lambda a: let(F.struct(a.alias("all"), F.slice(a, 1, 3).alias("first")), best))
    short = F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(c, 1, 200)))
    return let(chosen, lambda a: F.when(F.size(a) > 0, a).otherwise(short))


def code_description(c: Column, table: Mapping[str, str] = P.CODE_DESCRIPTIONS) -> Column:
    """Description of the longest known prefix (4, 3, 1) followed by the code."""
    known = _lookup(table)
    hits = [F.try_element_at(known, F.upper(F.substring(c, 1, n))) for n in (4, 3, 1)]
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat_ws("; ", F.coalesce(*hits), c))


def rich_text(rec: Mapping[str, Column], words: Sequence[str] = P.KEY_WORDS) -> Column:
    """Weighted text of a record: topic three times, titles, key sentences, code, parties, type."""

    def part(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    def joined(c: Column, n: int) -> Column:
        return let(key_sentences(c, n, words), lambda a: F.array_join(a, " "))

    topic = part("技术领域:", rec["topic"])
    return F.concat_ws(
        " [SEP] ",
        topic,
        topic,
        topic,
        part("标题:", rec["title"]),
        part("Title:", rec["title_en"]),
        part("摘要:", joined(rec["abstract"], 3)),
        part("Abstract:", joined(rec["abstract_en"], 2)),
        part("技术分类:", code_description(rec["code"])),
        part("申请人:", F.array_join(F.slice(rec["parties"], 1, 5), ",")),
        part("类型:", rec["item_type"]),
    )


def strip_code_fence(c: Column) -> Column:
    """Drop markdown fence lines when the text starts with one."""
    return let(
        strip(c),
        lambda s: F.when(
            s.startswith("```"),
            strip(F.array_join(F.filter(F.split(s, "\n"), lambda x: ~strip(x).startswith("```")), "\n")),
        ).otherwise(s),
    )


def clean_generated_query(c: Column) -> Column:
    """Comments off, prose lines out, blanks squeezed, line by line."""

    def clean(line: Column) -> Column:
        line = F.split(line, "--", 2)[0]
        line = F.split(line, "//", 2)[0]
        line = F.regexp_replace(line, r"""^((?:[^#'"]|'[^']*'|"[^"]*")*)#.*$""", "$1")
        return F.regexp_replace(line, r"/\*.*?\*/", "")

    def is_prose(line: Column) -> Column:
        upper = F.upper(line)
        code = contains_any(upper, P.CODE_WORDS) | contains_any(line, P.CODE_SIGNS)
        han = F.length(F.regexp_replace(line, "[^一-鿿]", ""))
        return (F.length(strip(line)) > 0) & (han / F.greatest(F.length(strip(line)), F.lit(1)) > 0.5) & ~code

    def without_remarks(line: Column) -> Column:
        # a run of more than five Han characters outside quotes is a remark
        return F.regexp_replace(line, r"""('[^']*'|"[^"]*")|[\x{4e00}-\x{9fff}，。：、；？！]{6,}""", "$1")

    lines = F.filter(F.transform(F.split(c, "\n"), clean), lambda x: ~is_prose(x))
    lines = F.filter(F.transform(lines, lambda x: squeeze(without_remarks(x))), lambda x: x != "")
    return F.array_join(lines, "\n")


def extract_json(c: Column, default: str | None = None) -> Column:
    """JSON in model text: fences off, else the widest bracketed span, else the default."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, r"```json?\s*", ""), r"```\s*$", ""))

    def pick(s: Column) -> Column:
        span = F.regexp_extract(s, r"(?s)([\[{].*[\]}])", 1)
        return (
            F.when(F.try_parse_json(s).isNotNull(), s)
            .when((span != "") & F.try_parse_json(span).isNotNull(), span)
            .otherwise(F.lit(default))
        )

    return let(bare, pick)


def rewrite(c: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Apply ordered (pattern, replacement, tag) rules; `struct<text, fixes array<string>>`."""
    table = F.array(
        *[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("replacement"), F.lit(t).alias("tag")) for p, r, t in rules]
    )
    start = F.struct(c.alias("text"), F.array().cast("array<string>").alias("fixes"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct(
            F.regexp_replace(acc.text, r.pattern, r.replacement).alias("text"),
            F.when(F.regexp_like(acc.text, r.pattern), F.array_append(acc.fixes, r.tag)).otherwise(acc.fixes).alias("fixes"),
        )

    return F.aggregate(table, start, step)


def remap_roles(messages: Column, roles: Mapping[str, str], role: str = "from", value: str = "value") -> Column:
    """Rename the roles of a conversation; an unknown role is an error."""
    known = _lookup(roles)
    return F.transform(
        messages,
        lambda m: F.struct(
            F.coalesce(
                F.try_element_at(known, m[role]),
                F.raise_error(F.concat(F.lit("unknown role: "), m[role])).cast("string"),
            ).alias("role"),
            m[value].alias("content"),
        ),
    )


def validate_filters(filters: Mapping[str, object]) -> tuple[dict[str, object], list[str]]:
    """Canonical values for the topic, status and region keys of a filter, with warnings.

    The driver-side twin of `canonical_value` for the handful of literals in one filter.
    """

    def match(value: str, valid: Sequence[str], words: Mapping[str, str], both_ways: bool) -> str | None:
        if not value:
            return None
        if value in valid:
            return value
        for v in valid:
            if value in v or v in value:
                return v
        for word, v in words.items():
            if word in value or (both_ways and value in word):
                return v
        return None

    vocab = {
        "domain": (P.TOPICS, P.TOPIC_WORDS, False),
        "legal_status": (P.LEGAL_STATES, P.LEGAL_STATE_WORDS, True),
    }
    out: dict[str, object] = {}
    warnings: list[str] = []
    for key, value in filters.items():
        base = key.removesuffix("_in")
        if base == "domain" and key == "domain" and isinstance(value, list):
            warnings.append(f"domain list taken as {'domain' if len(value) == 1 else 'domain_in'}")
            key, value = ("domain", value[0]) if len(value) == 1 else ("domain_in", value)
        if base in vocab:
            wanted = value if isinstance(value, list) else [value]
            found = []
            for v in wanted:
                hit = match(v, *vocab[base])
                if hit is None:
                    warnings.append(f"{base} '{v}' is unknown and was ignored")
                    continue
                if hit != v:
                    warnings.append(f"{base} '{v}' was taken as '{hit}'")
                found.append(hit)
            if found:
                out[key] = found if isinstance(value, list) else found[0]
        elif base == "region":
            named = [P.COLLOQUIAL_REGIONS.get(v, v) for v in (value if isinstance(value, list) else [value])]
            out[key] = named if isinstance(value, list) else named[0]
        elif key == "keywords" and isinstance(value, list):
            out[key] = " ".join(str(v) for v in value)
        else:
            out[key] = value
    return out, warnings
