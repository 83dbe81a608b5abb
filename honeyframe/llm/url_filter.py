"""Operator 7: URL rules, and for URLs that no rule fits the ratio of two character language models.

URLs that the rules allow or block teach a smoothed variable-order Markov model each. A character's probability after its
last four is interpolated with those after the last three, two, one and none, each order trusted as far as its context
was seen: P_k = (n(context, char) + M * P_{k-1}) / (n(context) + M), down to a uniform P over 256 characters. A URL's
score is the mean over its characters of the log of allowed over blocked. The cut is calibrated on a fifth of the
URLs with a rule, by their hash, that the models have not seen: the one that tells the two kinds apart best.

The models read the whole URL as it is written. All of it is DataFrame functions. Logs are rounded to millionths as whole
numbers, so that sums don't depend on order. Each distinct URL is parsed and scored once; copies of one URL meet only in a
join whose large keys Spark can split. Contexts of no or one character, which all grams share, are broadcast: no more rows
than there are characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import materialise

#: A rule's host with its path, and what it says.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDER, TRUST = 4, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that are taken apart at once.
STRETCH = 256
#: Stand before a URL's first character and after its last.
_START, _END = "\x02", "\x03"


def parse(url: str) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL column; both empty for null and without ``://``."""
    rest = F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) ELSE '' END")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(raw) + 1)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none does."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(says)
    return rule, says


def _grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """Each character of a URL, and its end, with the ``ORDER`` characters before it.

    A URL is taken apart in stretches first, as a place in a text is found by counting from the text's beginning.
    """
    padded = F.concat(F.lit(_START * ORDER), F.col("s"), F.lit(_END))
    first = F.sequence(F.lit(1), F.length("s") + 1, F.lit(STRETCH))
    pieces = urls.select(*keep, F.explode(F.transform(first, lambda i: F.substr(padded, i, F.lit(STRETCH + ORDER)))).alias("piece"))
    at = F.sequence(F.lit(1), F.length("piece") - ORDER)
    return pieces.select(*keep, F.explode(F.transform(at, lambda i: F.substr("piece", i, F.lit(ORDER + 1)))).alias("gram"))


def _suffixes(grams: DataFrame, keep: list[str]) -> DataFrame:
    """A gram's own suffixes, of 1 to ORDER + 1 characters."""
    sizes = F.array(*[F.lit(k) for k in range(1, ORDER + 2)])
    return grams.select(*keep, F.explode(F.transform(sizes, lambda k: F.substr("gram", ORDER + 2 - k, k))).alias("tail"))


def log_ratios(trained: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each distinct gram of ``wanted`` the log, in millionths, of its allowed over its blocked probability; ``trained`` has s and good (1 or 0)."""
    counts = _grams(trained, ["good"]).groupBy("gram").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b"))
    tails = _suffixes(counts, ["a", "b"]).groupBy("tail").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    contexts = tails.groupBy(F.expr("substring(tail, 1, length(tail) - 1)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    rows = _suffixes(_grams(wanted, []).distinct(), ["gram"]).join(tails, "tail", "left")
    rows = rows.withColumn("context", F.expr("substring(tail, 1, length(tail) - 1)"))
    short, few = F.length("context") <= 1, F.broadcast(contexts.filter("length(context) <= 1"))
    rows = rows.filter(short).join(few, "context", "left").unionByName(rows.filter(~short).join(contexts, "context", "left"))
    n = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "b", "ca", "cb")]
    chain = rows.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.length("tail").alias("k"), *n))).alias("chain"))

    def probability(of: str, context: str) -> Column:
        return F.aggregate("chain", F.lit(1 / 256), lambda p, x: (x[of] + TRUST * p) / (x[context] + TRUST))

    ratio = F.ln(probability("a", "ca") / probability("b", "cb"))
    return chain.select("gram", F.round(ratio * 1e6).cast("long").alias("ratio"))


def score_urls(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """Of rows with s that their other columns tell apart: those, and the score in thousandths of a log unit per character, rounded down."""
    keys = [c for c in urls.columns if c != "s"]
    total = _grams(urls, keys).join(ratios, "gram").groupBy(*keys).agg(F.sum("ratio").alias("sum"), F.count("*").alias("n"))
    return total.select(*keys, F.floor(F.col("sum") / (1000.0 * F.col("n"))).cast("long").alias("score"))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row with the cut: of the scores of ``scored`` (score, good) the smallest at or over which lies most of the allowed less the blocked; 0 without both kinds.

    Scores are whole thousandths between bounds that the models' smoothing sets, so the table of distinct ones stays small.
    """
    by = scored.groupBy("score").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b"))
    by = by.agg(F.array_sort(F.collect_list(F.struct("score", "a", "b"))).alias("all"))
    total = by.select("all", F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x["a"]).alias("ta"), F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x["b"]).alias("tb"))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("best"), F.lit(None).cast("long").alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        # what the cut x leaves under it: acc.a and acc.b; gain as a whole number, over the common denominator ta * tb
        gain = (F.col("ta") - acc["a"]) * F.col("tb") - (F.col("tb") - acc["b"]) * F.col("ta")
        better = acc["cut"].isNull() | (gain > acc["best"])
        return F.struct((acc["a"] + x["a"]).alias("a"), (acc["b"] + x["b"]).alias("b"), F.when(better, gain).otherwise(acc["best"]).alias("best"), F.when(better, x["score"]).otherwise(acc["cut"]).alias("cut"))

    cut = F.aggregate("all", zero, step)["cut"]
    return total.select(F.when((F.col("ta") > 0) & (F.col("tb") > 0), cut).otherwise(F.lit(0)).cast("long").alias("cut"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict, and score where no rule fits.

    A null URL is an empty one; it and one without ``://`` have an empty host and path, which no rule fits, and are scored
    like any other, as very long ones are. A score equal to the cut allows. Repeated rows, null ids and ties each get a
    row. Only the two named columns are read, so others can't clash. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("s"))
    host, path = parse("s")
    urls = rows.select("s").distinct().select("s", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    # Written with a number for each, so that only numbers go along with what is counted.
    urls = materialise(urls.select(F.monotonically_increasing_id().alias("u"), "s", "host", "path", rule.alias("rule"), says.alias("says")), "urls")
    labelled = urls.filter("says is not null").select("u", "s", (F.col("says") == "allow").cast("long").alias("good"))
    unseen = F.pmod(F.crc32(F.col("s").cast("binary")), F.lit(5)) == 0
    free = urls.filter("says is null").select("u", "s", F.lit(None).cast("long").alias("good"))
    wanted = free.unionByName(labelled.filter(unseen))
    ratios = log_ratios(labelled.filter(~unseen), wanted)
    scored = materialise(score_urls(wanted, ratios), "scored")
    cut = calibrate(scored.filter("good is not null"))
    judged = scored.filter("good is null").crossJoin(F.broadcast(cut))  # one row
    judged = judged.select("u", "score", F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block").alias("found"))
    every = materialise(urls.join(judged, "u", "left").select("s", "host", "path", "rule", F.coalesce("says", "found").alias("verdict"), "score"), "judged")
    return rows.join(every, "s").select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")


_P = f"""translate(CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substring(url, position('://' IN url) + 3), '^[^/?#]*', 0) ELSE '' END, '{_UPPER}', '{_LOWER}')"""
_T = """CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substring(url, position('://' IN url) + 3 + length(regexp_extract(substring(url, position('://' IN url) + 3), '^[^/?#]*', 0))), '^[^?#]*', 0) ELSE '' END"""


def _sql_rules() -> tuple[str, str]:
    rule, says = "", ""
    for text, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        of, slash, rest = text.partition("/")
        fits = f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash}{rest}')"
        rule, says = f"{rule} {fits} THEN '{text}'", f"{says} {fits} THEN '{verdict}'"
    return f"CASE{rule} END", f"CASE{says} END"


def _sql_chain(of: str) -> str:
    p = "CAST(1 AS DOUBLE) / 256"
    for k in range(1, ORDER + 2):
        p = f"(({of}{k} + {TRUST} * ({p})) / (c{of}{k} + {TRUST}))"
    return p


def oracle_sql() -> str:
    """The same in DuckDB's SQL, over the table pages."""
    rule, says = _sql_rules()
    columns = ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN {x} END), 0)::DOUBLE AS {x}{k}" for k in range(1, ORDER + 2) for x in ("a", "b", "ca", "cb"))
    grams = f"unnest([substring(repeat(chr(2), {ORDER}) || s || chr(3), i, {ORDER + 1}) FOR i IN generate_series(1, length(s) + 1)]) AS gram"
    tails = f"unnest([substring(gram, {ORDER + 2} - k, k) FOR k IN generate_series(1, {ORDER + 1})]) AS tail"
    crc = _sql_crc32("s")
    return f"""
WITH rows AS (SELECT page_id, url, {_P} AS host, {_T} AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
), ruled AS (SELECT *, {rule} AS rule, {says} AS says FROM rows
), urls AS (SELECT DISTINCT says, url AS s FROM ruled
), hashed AS (SELECT *, {crc} % 5 = 0 AS unseen FROM urls
), wanted AS (
  SELECT s, CAST(NULL AS INT) AS good FROM hashed WHERE says IS NULL UNION ALL SELECT s, CAST(says = 'allow' AS INT) FROM hashed WHERE says IS NOT NULL AND unseen
), counts AS (SELECT gram, sum(good) AS a, sum(1 - good) AS b FROM (SELECT CAST(says = 'allow' AS INT) AS good, {grams} FROM hashed WHERE says IS NOT NULL AND NOT unseen) GROUP BY gram
), tails AS (SELECT tail, sum(a) AS a, sum(b) AS b FROM (SELECT a, b, {tails} FROM counts) GROUP BY tail
), contexts AS (SELECT substring(tail, 1, length(tail) - 1) AS context, sum(a) AS ca, sum(b) AS cb FROM tails GROUP BY 1
), asked AS (SELECT s, {grams} FROM wanted
), chains AS (
  SELECT gram, {columns} FROM (
    SELECT gram, length(tail) AS k, a, b, ca, cb FROM (SELECT gram, {tails} FROM (SELECT DISTINCT gram FROM asked)) q
    LEFT JOIN tails USING (tail) LEFT JOIN contexts ON context = substring(q.tail, 1, length(q.tail) - 1)
  ) GROUP BY gram
), ratios AS (SELECT gram, CAST(round(ln({_sql_chain('a')} / {_sql_chain('b')}) * 1e6) AS BIGINT) AS ratio FROM chains
), scored AS (
  SELECT s, CAST(floor(sum(ratio)::DOUBLE / (1000.0::DOUBLE * count(*))) AS BIGINT) AS score FROM asked JOIN ratios USING (gram) GROUP BY s
), held AS (SELECT score, good FROM scored JOIN wanted USING (s) WHERE good IS NOT NULL
), by_score AS (SELECT score, sum(good) AS a, sum(1 - good) AS b FROM held GROUP BY score
), gains AS (
  SELECT score, (sum(a) OVER () - coalesce(sum(a) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * sum(b) OVER ()
    - (sum(b) OVER () - coalesce(sum(b) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * sum(a) OVER () AS gain, sum(a) OVER () > 0 AND sum(b) OVER () > 0 AS both_kinds FROM by_score
), cut AS (SELECT coalesce((SELECT score FROM gains WHERE both_kinds ORDER BY gain DESC, score LIMIT 1), 0) AS cut)
SELECT page_id, r.host, r.path, r.rule, coalesce(r.says, CASE WHEN s.score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r LEFT JOIN scored s ON r.url = s.s CROSS JOIN cut
"""


def _sql_crc32(column: str) -> str:
    """CRC-32 bit by bit, since the engine has no function for it."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = "xor(c, b)"
    for _ in range(8):
        byte = f"(list_transform([{byte}], lambda c: {bit}))[1]"
    octets = f"list_transform(range(0, octet_length(encode({column}))), lambda j: CAST('0x' || substring(hex(encode({column})), CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {byte}), 4294967295)"
