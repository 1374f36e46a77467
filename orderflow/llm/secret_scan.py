"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern, with their places in code points. The hash of each candidate's value is counted over
the corpus by distinct repositories and owners: what many owners have is a copied example, and what few
owners have, and looks random, is taken for live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.text import bound, running_total
from orderflow.llm._shared import table, written

#: kind: pattern, group that holds the value, least length of that group, and words of which a text must have one, in lower case.
KINDS = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ()),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("gh",)),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, ("xox",)),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, ("eyj",)),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("private key",)),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39, ("aiza",)),
    "stripe": (r"[rs]k_live_[A-Za-z0-9]+", 0, 24, ("k_live_",)),
    "npm": (r"npm_[A-Za-z0-9]+", 0, 40, ("npm_",)),
    "bearer": (r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 20, ("bearer",)),
    "url": (r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/:@?#"'<>]*:([^\x00-\x20/:@?#"'<>]+@)""", 1, 6, ("://",)),
}
#: A private key in whole, with its body and what ends it as the value: through the END line, without one to the end of its
#: base64 lines, however many, and a bare header has no value. The repeats are possessive, so the engine takes no stack for them.
#: SQL knows the header only, as its expressions cannot look ahead.
PEM = (
    KINDS["pem"][0] + r"(?:\s|\\[nr])*+([^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[A-Za-z][A-Za-z-]*:\x20[^\r\n]*+\s++)*+(?:[\x20\t>*#\"']*+[A-Za-z0-9+/=]{16,}+[\"',;+]*+(?:\s|\\[nr])*+)++(?:[A-Za-z0-9+/]++={0,2}(?![^\r\n\\]))?|)"
)
#: What does not tell two private keys apart: the END line, blanks and escaped line ends.
_PEM_FRAME = r"-----END[\x00-\x7F]*$|\\[nr]|\s+"
BASE = ("assign", "access", "hex")
#: Owners, and repositories, from which on a value counts as widely copied.
COMMON_OWNERS, COMMON_REPOS = 3, 6
#: Parts that the uses of each value are dealt to, as one value may be in a third of all rows.
PARTS = 16

_SPAN = "array<struct<start:int,kind:int,end:int,value_start:int,value:string>>"


def _spans_of(text: Column, kind: str) -> Column:
    """All matches of a kind, leftmost and not overlapping; those with a short value are dropped after matching."""
    pattern, group, least, _ = KINDS[kind]
    if kind == "pem":
        pattern, group = PEM, 1
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    values = F.regexp_extract_all(text, F.lit(pattern), group)
    ends = lambda ms: running_total(F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: g + F.length(m)))
    placed = lambda ms: F.zip_with(ms, ends(ms), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
    row = lambda r, v: F.struct(
        r["start"].alias("start"),
        F.lit(list(KINDS).index(kind)).alias("kind"),
        r["end"].alias("end"),
        (r["end"] - F.length(v)).alias("value_start"),  # the value ends the match in every kind
        (F.regexp_replace(v, _PEM_FRAME, "") if kind == "pem" else v).alias("value"),
    )
    rows = bound(F.regexp_extract_all(text, F.lit(pattern), 0), lambda ms: F.zip_with(placed(ms), values, row))
    return F.filter(rows, lambda r: F.length(r["value"]) >= least).cast(_SPAN)


def spans(text: Column) -> Column:
    """All candidates of a text by start, then kind. Regular expressions run only where a plain search finds a kind's words."""
    low, none, parts = F.lower(text), F.array().cast(_SPAN), []
    for kind, (pattern, _, _, words) in KINDS.items():
        may = F.lit(not words)
        for w in words:
            may = may | F.contains(low, F.lit(w))
        parts.append(F.when(may & text.rlike(pattern), _spans_of(text, kind)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _looks_live(value: Column, kind: Column) -> Column:
    """Whether a value looks random; a private key does by its form, unless it says that it is none."""
    key = (F.length(value) >= 16) & ~F.lower(value).rlike("example|placeholder|changeme|x{8}")
    return F.when(kind == list(KINDS).index("pem"), key).otherwise(_looks_random(value))


def _looks_random(value: Column) -> Column:
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~F.lower(value).rlike("example|sample|dummy|placeholder|changeme|xxxx")


def _candidates(text: Column) -> Column:
    """The spans of a text, with a hash of each value and whether it looks live in place of the value: values are not stored."""
    return F.transform(spans(text), lambda s: F.struct(
        s["start"], s["kind"], s["end"], s["value_start"], F.sha2(s["value"], 256).alias("value_hash"), _looks_live(s["value"], s["kind"]).alias("live")
    ))


def ownership(uses: DataFrame) -> DataFrame:
    """``(value_hash, owner, repo)`` to ``value_hash, n_owners, n_repos, n_uses``. Combined before each shuffle,
    so a value in a third of all rows arrives as few rows; null is an owner of its own."""
    by_repo = uses.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_uses")
    )


def judged(found: DataFrame, common_owners: int = COMMON_OWNERS, common_repos: int = COMMON_REPOS) -> DataFrame:
    """``(rid, owner, repo, spans)`` to one row per candidate: ``rid, span, common, live``.

    A value of as many owners or repositories is widely copied, and not live. Only such values are joined with their uses,
    and each use meets one of ``PARTS`` copies.
    """
    uses = found.select("rid", "owner", "repo", F.explode("spans").alias("span")).withColumn("value_hash", F.col("span.value_hash"))
    copied = ownership(uses).where((F.col("n_owners") >= common_owners) | (F.col("n_repos") >= common_repos))
    copied = copied.select("value_hash", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(True).alias("copied"))
    dealt = uses.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(PARTS)).cast("int"))
    common = F.coalesce("copied", F.lit(False))
    return dealt.join(copied, ["value_hash", "part"], "left").select("rid", "span", common.alias("common"), (~common & F.col("span.live")).alias("live"))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _repo(docs: DataFrame, owner: Column, repo: Column | None) -> Column:
    """The repository: as asked, or else owner and language, or the owner where there is no language."""
    return repo if repo is not None else F.concat_ws("/", owner, F.col("lang")) if "lang" in docs.columns else owner


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo: Column | None = None,
    common_owners: int = COMMON_OWNERS,
    common_repos: int = COMMON_REPOS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``found`` (its candidates: places, kind, a hash of the value), and how
    many of them are widely copied (``n_common``) and live-looking (``n_live``).

    ``repo`` defaults to owner and language. A null text has no candidates; null owners are one owner; null ids
    and repeated rows are given as they come.
    """
    owner = F.col(owner_col)
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), _repo(docs, owner, repo).alias("repo"), _candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("spans")
    ).withColumn("rid", F.monotonically_increasing_id())
    found = written(found, "spans")
    counts = judged(found, common_owners, common_repos).groupBy("rid").agg(F.count_if("common").alias("n_common"), F.count_if("live").alias("n_live"))
    zero = F.lit(0).cast("long")
    return found.join(counts, "rid", "left").select(
        "doc_id", F.col("spans").alias("found"), F.coalesce("n_common", zero).alias("n_common"), F.coalesce("n_live", zero).alias("n_live")
    )


def redact(
    docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo: Column | None = None, common_owners: int = COMMON_OWNERS, common_repos: int = COMMON_REPOS
) -> DataFrame:
    """``docs`` with every secret's value replaced by ``<SECRET>``, or by ``<EXAMPLE>`` if it is widely copied.

    All rows and columns stay; ``n_chars`` follows the text. Rows without a candidate pass untouched. ``repo`` is a column of
    ``docs``, as in ``scan``.
    """
    cols = docs.columns
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"),
        F.col(f"`{owner_col}`").alias("owner"),
        _repo(docs, F.col(f"`{owner_col}`"), repo).alias("repo"),
        _candidates(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("spans"),
    )
    plain = marked.where(F.size("spans") == 0).select("row.*")
    found = written(marked.where(F.size("spans") > 0).withColumn("rid", F.monotonically_increasing_id()), "found")
    marks = judged(found, common_owners, common_repos).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("span.value_start", "span.end", "common"))).alias("marks"))
    text = F.col(f"row.`{text_col}`")
    step = lambda a, s: F.when((s["end"] <= a["at"]) | (s["value_start"] == s["end"]), a).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(
                a["out"],
                F.when(s["value_start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["value_start"] - a["at"]), F.when(s["common"], F.lit("<EXAMPLE>")).otherwise(F.lit("<SECRET>")))).otherwise(F.lit("")),
            ).alias("out"),
        )
    )
    done = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = found.join(marks, "rid").select("row", done.alias("__done"))
    put = {text_col: F.col("__done")} | ({"n_chars": F.length("__done").cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    return plain.unionByName(new.select(*(put.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secret spans, and how many are widely copied or live-looking."""
    found = scan(table(spark, sf_dir, "documents"))
    of = {k: F.filter("found", lambda s: s["kind"] == i) for i, k in enumerate(KINDS)}  # noqa: B023
    return found.select(
        "doc_id",
        *(F.size(of[k]).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        "n_common",
        "n_live",
    )


def op5_oracle() -> str:
    """The same rows in DuckDB SQL, but for private keys, of which it knows the header only."""
    parts = []
    for i, (kind, (pattern, group, least, _)) in enumerate(KINDS.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""
        SELECT rid, {i} AS k, '{kind}' AS kind, a AS s, a + length(m) AS e, v FROM (
            SELECT rid, unnest(ms) AS m, unnest(vs) AS v,
                   unnest(list_transform(range(1, len(ms) + 1), lambda i: length(array_to_string(ps[1:i], '')) + length(array_to_string(ms[1:i-1], '')))) AS a
            FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS ps
                  FROM d WHERE regexp_matches(t, '{p}')))
        WHERE length(v) >= {least}""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    o AS (SELECT v, count(DISTINCT source) >= {COMMON_OWNERS} OR count(DISTINCT concat_ws('/', source, lang)) >= {COMMON_REPOS} AS c FROM f JOIN d USING (rid) GROUP BY v),
    g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS a,
            count(*) FILTER (c) AS n_common,
            count(*) FILTER (NOT c AND length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
                AND NOT regexp_matches(lower(v), 'example|sample|dummy|placeholder|changeme|xxxx')) AS n_live
          FROM f JOIN o USING (v) GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_common, 0)::BIGINT AS n_common, coalesce(n_live, 0)::BIGINT AS n_live
    FROM d LEFT JOIN g USING (rid)
    """
