"""Quality rules: fixed rules, then robust multivariate outliers among the texts that pass them.

Each text gives a vector of transformed statistics. Per (lang, source) group a minimum-covariance-
determinant estimate is reached by concentration steps: the 75 % of texts nearest to the centre give the
next mean and covariance, STEPS times. They start three times, from medians and median deviations, from the half of the
texts that these put nearest, and from all texts, and of the three ends a group takes that of least
determinant. Texts at a squared Mahalanobis distance over CUTOFF are rejected. Vectors are fixed-point integers, so group sums are exact and don't depend
on the order of rows; subset borders come from exact histograms of distance bins, which
aggregate before the shuffle, so a hot group costs no more than its bins. Groups under
MIN_GROUP texts pool by language, then altogether; pools still under MIN_GROUP reject nothing.
DataFrame functions only.

Cases: a null text has no word and fails the rules; null lang or source count as empty;
repeated rows each count and get a row; extra input columns are ignored; an empty table gives no rows.
Word windows and lines are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import SPACE, let, lookup, materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
STEPS = 5
#: Starts of the concentration steps, and decimals of a log determinant that tell ends apart; of equal ones the first start's is taken.
STARTS, DIGITS = 3, 6
MIN_GROUP = 50
#: Fixed-point units of the statistics and the least standard deviation of each in those units.
UNIT = 1000
FLOORS = {"log_word_length": 50, "root_symbols": 40, "root_capitals": 40, "root_dup_lines": 100, "root_marks": 40}
NAMES = list(FLOORS)
#: Share of a group that a concentration step keeps, and the factor that makes the covariance of that share of normal
#: vectors of five dimensions consistent: 0.75 / P(chi2_7 <= q), q the 0.75 quantile of chi2_5.
KEEP, CONSISTENT = 0.75, 1.4006
#: Squared distance beyond which a text is an outlier; a chi-square of five degrees exceeds it with probability 1e-9.
CUTOFF = 50.0
#: Bins per doubling of the squared distance.
BINS = 64


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = " \t\n\x0b\f\r"
    squeezed = F.btrim(text, F.lit(blank))
    words = F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, SPACE, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(h):
        return F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))

    def covered(at):
        """Words in the union of the windows that begin at the sorted positions ``at``."""
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), p + 3) - p)), F.lit(0).cast("long"), lambda s, x: s + x)

    def by_sort(w):
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(True) | ((j > 0) & (x["h"] == F.get(s, j - 1)["h"])).eqNullSafe(True))
        return let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))

    def repeated(w):
        found = lambda s: F.filter(s, lambda x, j: (j > 0) & (x == F.get(s, j - 1)))
        few = lambda d: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(d, F.get(w, i)))
        # both ways give the same positions; a list of few repeated windows is searched, a long one is found by sorting
        at = lambda d: F.when(F.size(d) <= 32, few(d)).otherwise(by_sort(w))
        return let(let(F.sort_array(w), found), lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(let(at(d), covered)))

    return (
        docs.withColumn("_words", words)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, blank, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_capitals", F.regexp_count(text, F.lit("[A-ZÀ-Þ]")).cast("long"))
        .withColumn("n_marks", F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", let(F.transform("_words", lambda x: F.xxhash64(x)), lambda h: let(windows(h), repeated)))
        .drop("_words", "_lines")
    )


def vector() -> list:
    whole = lambda x: F.round(UNIT * x).cast("long")
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        whole(F.log(chars / F.greatest(F.col("n_words"), F.lit(1)))).alias("log_word_length"),
        whole(F.sqrt(F.col("n_symbols") / chars)).alias("root_symbols"),
        whole(F.sqrt(F.col("n_capitals") / chars)).alias("root_capitals"),
        whole(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))).alias("root_dup_lines"),
        whole(F.sqrt(F.col("n_marks") / chars)).alias("root_marks"),
    ]


def _quantile(cells: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """The least value at which a group's counts reach ``share`` of all. cells: (g, value, n), one row per value."""
    run = Window.partitionBy("g").orderBy(value)
    counted = cells.select("g", value, F.sum("n").over(run).alias("run"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    return counted.where(F.col("run") >= F.ceil(F.lit(share) * F.col("all"))).groupBy("g").agg(F.min(value).alias(name))


def _distance(x: list[str]) -> F.Column:
    """Squared distance by forward substitution in the Cholesky factor l_i_j of the covariance."""
    y: list = []
    for i, name in enumerate(x):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        y.append(rest / F.col(f"l_{i}_{i}"))
    return y


def distances(rows: DataFrame) -> DataFrame:
    for i, y in enumerate(_distance(NAMES)):
        rows = rows.withColumn(f"y_{i}", y)
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(NAMES))), F.col("y_0") * F.col("y_0"))).drop(*[f"y_{i}" for i in range(len(NAMES))])


def _factor(moments: DataFrame) -> DataFrame:
    """Mean and Cholesky factor per group from n, s_i and q_i_j."""
    k = range(len(NAMES))
    out = moments.select("g", "n", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in k], *[F.col(f"q_{i}_{j}") for i in k for j in range(i + 1)])
    for i in k:
        for j in range(i + 1):
            cov = CONSISTENT * (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}"))
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + F.lit(float(FLOORS[NAMES[i]]) ** 2)
            for p in range(j):
                cov = cov - F.col(f"l_{i}_{p}") * F.col(f"l_{j}_{p}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(cov, F.lit(1.0))) if i == j else cov / F.col(f"l_{j}_{j}"))
    return out.drop(*[f"q_{i}_{j}" for i in k for j in range(i + 1)])


def _moments(rows: DataFrame) -> DataFrame:
    k = range(len(NAMES))
    return rows.groupBy("g").agg(
        F.count("*").alias("n"), *[F.sum(NAMES[i]).alias(f"s_{i}") for i in k],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i in k for j in range(i + 1)],
    )


def _nearest_moments(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """Mean and factor of the ``share`` of each group's texts that the estimates ``now`` put nearest."""
    far = distances(lookup(rows, now, ["g"])).withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2"))).cast("long"))
    border = materialise(_quantile(far.groupBy("g", "bin").agg(F.count("*").alias("n")), "bin", share, "border"), "border")
    return _factor(_moments(lookup(far.select("g", "bin", *NAMES), border, ["g"]).where("bin <= border")))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Per group g: n, m_i and l_i_j of the concentrated subset of least determinant. rows: g and the vector, materialised."""
    k = range(len(NAMES))
    start = None
    for i, name in enumerate(NAMES):
        middle = _quantile(rows.groupBy("g", F.col(name).alias("v")).agg(F.count("*").alias("n")), "v", 0.5, f"m_{i}")
        start = middle if start is None else start.join(middle, "g")
    start = materialise(start, "medians")
    centred = lookup(rows, start, ["g"])
    for i, name in enumerate(NAMES):
        spread = _quantile(centred.groupBy("g", F.abs(F.col(name) - F.col(f"m_{i}")).alias("v")).agg(F.count("*").alias("n")), "v", 0.5, f"l_{i}_{i}")
        start = start.join(spread.withColumn(f"l_{i}_{i}", F.greatest(1.4826 * F.col(f"l_{i}_{i}"), F.lit(float(FLOORS[name])))), "g")
    shape = ["g", *[f"m_{i}" for i in k], *[f"l_{i}_{j}" for i in k for j in range(i + 1)]]
    medians = materialise(start.select("*", *[F.lit(0.0).alias(f"l_{i}_{j}") for i in k for j in range(i)]).select(shape), "start")
    starts = [medians, _nearest_moments(rows, medians, 0.5).select(shape), _factor(_moments(rows)).select(shape)]
    named = lambda c: F.struct("g", c.alias("start")).alias("g")
    now = starts[0].withColumn("g", named(F.lit(0)))
    for s in range(1, STARTS):
        now = now.union(starts[s].withColumn("g", named(F.lit(s))))
    now = materialise(now, "starts")
    each = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).select(named(F.col("start")), *NAMES)
    for _ in range(STEPS):
        now = materialise(_nearest_moments(each, now, KEEP), "step")
    volume = F.round(sum((F.log(F.col(f"l_{i}_{i}")) for i in k), F.lit(0.0)), DIGITS)
    ends = now.select(F.col("g.g").alias("g"), F.struct(volume.alias("volume"), F.col("g.start").alias("start")).alias("rank"), F.struct(*[c for c in now.columns if c != "g"]).alias("end"))
    return materialise(ends.groupBy("g").agg(F.min_by("end", "rank").alias("end")).select("g", "end.*"), "least")


def grouped(rows: DataFrame) -> DataFrame:
    """Adds g: lang and source, or lang, or nothing where a group has under MIN_GROUP texts."""
    rows = rows.withColumn("_l", F.coalesce(F.col("lang").cast("string"), F.lit(""))).withColumn("_s", F.coalesce(F.col("source").cast("string"), F.lit("")))
    sites = rows.groupBy("_l", "_s").agg(F.count("*").alias("_n"))
    sites = sites.withColumn("_small", F.sum(F.when(F.col("_n") < MIN_GROUP, F.col("_n")).otherwise(0)).over(Window.partitionBy("_l")))
    g = F.when(F.col("_n") >= MIN_GROUP, F.to_json(F.array("_l", "_s"))).when(F.col("_small") >= MIN_GROUP, F.to_json(F.array("_l"))).otherwise(F.lit("[]"))
    return lookup(rows, materialise(sites.select("_l", "_s", g.alias("g")), "sites"), ["_l", "_s"]).drop("_l", "_s")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: statistics, base_failed, the squared distance (null where base_failed or not enough texts) and kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), "lang", "source")
    bad = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialise(text_statistics(slim, "_text").select("_id", "lang", "source", *counts, bad.alias("base_failed"), *vector()), "stats")
    passed = materialise(grouped(stats.where("not base_failed")), "passed")
    known = robust_estimates(passed.select("g", *NAMES))
    far = distances(lookup(passed, known, ["g"])).select("_id", *counts, "base_failed", F.when(F.col("n") >= KEEP * MIN_GROUP, F.col("d2")).alias("distance2"))
    failed = stats.where("base_failed").select("_id", *counts, "base_failed", F.lit(None).cast("double").alias("distance2"))
    return far.union(failed).select(F.col("_id").alias(id_col), *counts, "base_failed", (~F.col("base_failed") & ~F.coalesce(F.col("distance2") > CUTOFF, F.lit(False))).alias("kept"), F.round("distance2", 3).alias("distance2"))


def oracle() -> str:
    """The same rows in DuckDB SQL: the concentration steps written out one after another."""
    space = "[\\x20\\x09-\\x0D]"
    k = range(len(NAMES))
    size = lambda keep: f"CAST(length(regexp_replace(t, '{keep}', '', 'g')) AS BIGINT)"
    whole = lambda x: f"CAST(round({UNIT} * {x}) AS BIGINT)"
    chars = "greatest(word_chars, 1)"
    values = {
        "log_word_length": f"ln({chars}::DOUBLE / greatest(n_words, 1))", "root_symbols": f"sqrt(n_symbols::DOUBLE / {chars})", "root_capitals": f"sqrt(n_capitals::DOUBLE / {chars})",
        "root_dup_lines": "sqrt(n_dup_lines::DOUBLE / greatest(n_lines, 1))", "root_marks": f"sqrt(n_marks::DOUBLE / {chars})",
    }
    parts = [f"""
t0 AS (SELECT doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents),
t1 AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t0),
wi AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM t1),
tri AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q AS g FROM wi WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM twice) GROUP BY doc_id),
c0 AS (SELECT t1.doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words, {size(space)} AS word_chars, {size("[^#*$%&|<>]")} AS n_symbols, {size("[^A-ZÀ-Þ]")} AS n_capitals, {size("[^!-/:-@\\[-`{-~]")} AS n_marks,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM t1 LEFT JOIN rep USING (doc_id)),
st AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{whole(values[n])} AS x{i}" for i, n in enumerate(NAMES))} FROM c0),
si AS (SELECT l, s, count(*) AS n, sum(CASE WHEN count(*) < {MIN_GROUP} THEN count(*) ELSE 0 END) OVER (PARTITION BY l) AS small FROM st WHERE NOT base_failed GROUP BY l, s),
pa AS (SELECT st.*, CASE WHEN n >= {MIN_GROUP} THEN l || chr(1) || s WHEN small >= {MIN_GROUP} THEN l || chr(2) ELSE chr(3) END AS g FROM st JOIN si USING (l, s) WHERE NOT base_failed),
md AS (SELECT g, count(*) AS n, {", ".join(f"list_sort(list(x{i}))[ceil(0.5 * count(*))::BIGINT] AS m{i}" for i in k)} FROM pa GROUP BY g),
f0 AS (SELECT pa.g, any_value(n) AS n, {", ".join(f"any_value(m{i}) AS m{i}, greatest(1.4826::DOUBLE * list_sort(list(abs(x{i} - m{i})))[ceil(0.5 * any_value(n))::BIGINT], {float(FLOORS[n])}::DOUBLE) AS l{i}_{i}" for i, n in enumerate(NAMES))}{"".join(f", 0::DOUBLE AS l{i}_{j}" for i in k for j in range(i))} FROM pa JOIN md USING (g) GROUP BY pa.g)"""]

    def far(source: str, name: str, rows: str = "pa") -> str:
        out, last = [], f"(SELECT r.*, f.n AS kept_n, {', '.join(f'f.m{i}' for i in k)}, {', '.join(f'f.l{i}_{j}' for i in k for j in range(i + 1))} FROM {rows} r JOIN {source} f USING (g))"
        for i in k:
            rest = f"(x{i} - m{i})" + "".join(f" - l{i}_{j} * y{j}" for j in range(i))
            out.append(f"{name}y{i} AS (SELECT *, ({rest}) / l{i}_{i} AS y{i} FROM {last})")
            last = f"{name}y{i}"
        return ",\n".join([*out, f"{name} AS (SELECT *, {' + '.join(f'y{i} * y{i}' for i in k)} AS d2 FROM {last})"])

    sums = f"SELECT g, count(*) AS n, {', '.join(f'sum(x{i})::DOUBLE / count(*) AS m{i}' for i in k)}, {', '.join(f'sum(x{i} * x{j})::DOUBLE AS q{i}_{j}' for i in k for j in range(i + 1))}"

    def factor(source: str, step: str) -> str:
        """Adds the tables of the Cholesky factor of the sums in ``source``; gives the last one's name."""
        last = source
        for i in k:
            for j in range(i + 1):
                cov = f"{CONSISTENT} * (q{i}_{j} / n - m{i} * m{j})"
                if i == j:
                    cov = f"greatest({cov}, 0.0::DOUBLE) + {float(FLOORS[NAMES[i]]) ** 2}::DOUBLE"
                cov += "".join(f" - l{i}_{p} * l{j}_{p}" for p in range(j))
                parts.append(f"h{step}_{i}_{j} AS MATERIALIZED (SELECT *, {f'sqrt(greatest({cov}, 1.0::DOUBLE))' if i == j else f'({cov}) / l{j}_{j}'} AS l{i}_{j} FROM {last})")
                last = f"h{step}_{i}_{j}"
        return last

    def nearest(rows: str, old: str, step: str, share: float) -> str:
        parts.append(far(old, f"a{step}", rows))
        parts.append(f"b{step} AS MATERIALIZED (SELECT *, CAST(floor({BINS} * log2(1 + d2)) AS BIGINT) AS bin FROM a{step})")
        parts.append(f"e{step} AS (SELECT g, list_sort(list(bin))[ceil({share} * count(*))::BIGINT] AS border FROM b{step} GROUP BY g)")
        parts.append(f"c{step} AS MATERIALIZED ({sums} FROM b{step} JOIN e{step} USING (g) WHERE bin <= border GROUP BY g)")
        return factor(f"c{step}", step)

    shape = ", ".join(["n", *[f"m{i}" for i in k], *[f"l{i}_{j}" for i in k for j in range(i + 1)]])
    parts.append(f"ca AS ({sums} FROM pa GROUP BY g)")
    begun = ["f0", nearest("pa", "f0", "half", 0.5), factor("ca", "all")]
    parts.append("g0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g || chr(4) || '{s}' AS g, {shape} FROM {name}" for s, name in enumerate(begun)) + ")")
    parts.append(f"pb AS MATERIALIZED (SELECT pa.* EXCLUDE (g), g || chr(4) || start AS g FROM pa, (SELECT unnest({[str(x) for x in range(STARTS)]}) AS start))")
    now = "g0"
    for step in range(1, STEPS + 1):
        now = nearest("pb", now, str(step), KEEP)
    volume = f"round({' + '.join(f'ln(l{i}_{i})' for i in k)}, {DIGITS})"
    parts.append(f"least AS MATERIALIZED (SELECT string_split(g, chr(4))[1] AS g, {shape} FROM {now} QUALIFY row_number() OVER (PARTITION BY string_split(g, chr(4))[1] ORDER BY {volume}, string_split(g, chr(4))[2]) = 1)")
    parts.append(far("least", "z"))
    shown = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    d2 = f"CASE WHEN kept_n >= {KEEP * MIN_GROUP} THEN d2 END"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {shown}, NOT coalesce({d2} > {CUTOFF}, false) AS kept, round({d2}, 3) AS distance2 FROM z UNION ALL SELECT {shown}, false, NULL FROM st WHERE base_failed"
