"""URL filters by empirical-Bayes host reputation (operator 10).

Labelled page outcomes are counted by host, registered domain and suffix.
Each level's beta prior is centred on the shrunk rate of the level above; its
weight comes from how much the rates of that level spread (method of moments,
within fixed bounds). A page is blocked where even the lower bound of its
host's posterior bad rate is above a threshold. Explicit rules come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialise

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
Z = 1.64
THRESHOLD = 0.5
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 200.0
# Public suffixes of two labels that are told apart from registered domains (fixed values).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.nz", "co.in", "co.za", "co.kr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url"):
    """(host, path) columns: what stands between the first :// and /, ?, # or the end, and from there to ?, # or the end."""
    u = F.col(url).cast("string")
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def levels(host, suffixes=TWO_LABEL_SUFFIXES):
    """(suffix, registered domain) of a host column.

    A user name before @, a port and a dot at the end do not count. The suffix
    is the longest of ``suffixes`` (of two or three labels) that the host ends
    with, else its last label; the domain has one label more. An address of
    digits or in brackets, and a host of one label, is both.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", ""), r"\.$", "")
    parts = F.split(bare, r"\.")
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), F.lit(k)), ".")
    listed = lambda k: tail(k).isin(*[x for x in suffixes if x.count(".") == k - 1], "\x00")
    address = bare.rlike(r"^(?:\d+\.){3}\d+$") | bare.startswith("[")
    by = lambda one: F.when(address, bare).when(listed(3), tail(3 + one)).when(listed(2), tail(2 + one)).otherwise(tail(1 + one))
    return by(0), by(1)


def rule_columns(rules=RULES):
    """(rule, verdict) of the longest rule that fits host and path, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(f"{host}{path}")).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def prior_weight(counts: DataFrame, centre: str) -> float:
    """Pseudo-counts of the prior of one level: m(1-m) over the excess variance of its rates, less one.

    ``counts`` has n, bad and the rate that the level above gives. Groups of
    fewer than two labels say nothing about spread. Terms are rounded decimals,
    so that the order of a sum does not matter; two numbers reach the driver.
    """
    m = F.col(centre)
    got = F.col("bad") / F.col("n")
    exact = lambda x: F.avg(F.round(x, 9).cast("decimal(20,9)")).cast("double")
    v, x = counts.where("n >= 2").agg(exact(m * (1 - m)), exact((got - m) * (got - m) - m * (1 - m) / F.col("n"))).first()
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, v / x - 1)) if x and x > 0 else MOST_WEIGHT


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, suffix, domain, n, bad, posterior_mean, lower_bound) of every host in ``pages``.

    ``outcomes`` is (page_id, bad 0/1), at most one row for each page. Counts
    are partial sums of all labelled pages, so a host with a third of the
    pages is as cheap as any.
    """
    lab = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = levels(F.col("host"), suffixes)
    hosts = materialise(lab.withColumns({"suffix": suffix, "domain": domain}))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()

    def shrink(counts: DataFrame, centre: str, name: str) -> tuple[DataFrame, float]:
        k = prior_weight(counts, centre)
        return counts.withColumn(name, (F.col("bad") + k * F.col(centre)) / (F.col("n") + k)), k

    s, _ = shrink(suffixes.withColumn("m0", F.lit(((bad or 0) + 0.5) / ((n or 0) + 1.0))), "m0", "m1")
    d, _ = shrink(domains.join(s.select("suffix", "m1"), "suffix"), "m1", "m2")
    h, k = shrink(hosts.join(d.select("suffix", "domain", "m2"), ["suffix", "domain"]), "m2", "m3")
    spread = F.sqrt(F.col("m3") * (1 - F.col("m3")) / (F.col("n") + k + 1))
    return h.select("host", "suffix", "domain", "n", "bad", F.col("m3").alias("posterior_mean"), (F.col("m3") - Z * spread).alias("lower_bound"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """(page_id, bad): a labelled row is bad if its quality is 0; repeated ids count once, as their worst label."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior_mean, lower_bound for each row of ``pages``.

    A null url, or one without ://, has an empty host and path, and the host
    "" gets a reputation like any other. Repeated pages keep their rows; a page
    that several rows repeat counts once for each. No labels at all leave the
    prior of one half, whose bound blocks nothing. An empty table gives an
    empty result; a url of any length is a row. ``suffixes`` are the public
    suffixes of two or three labels (a list of the caller's, of a few thousand
    entries; the short one here serves tests). Only page_id and url are read,
    so columns of other names cannot clash.
    """
    host, path = split_url()
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).drop("url")
    rule, verdict = rule_columns(rules)
    out = rows.join(reputation(rows, outcomes, suffixes), "host", "left").withColumns({"rule": rule, "by_rule": verdict})
    own = F.when(F.col("lower_bound") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), F.round("posterior_mean", 6).alias("posterior_mean"), F.round("lower_bound", 6).alias("lower_bound"))


def judge_sql(pages: str = "pages", labels: str = "labels", rules=RULES, threshold: float = THRESHOLD, suffixes=TWO_LABEL_SUFFIXES) -> str:
    """DuckDB SQL for :func:`judge` with the outcomes of ``labels``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    bare = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '\.$', '')"
    tail = lambda k: f"array_to_string(ps[greatest(len(ps) - {k} + 1, 1):], '.')"
    listed = lambda k: f"{tail(k)} IN ({', '.join(map(quote, [*(x for x in suffixes if x.count('.') == k - 1), chr(1)]))})"
    by = lambda one: rf"CASE WHEN regexp_matches(bare, '^(?:\d+\.){{3}}\d+$') OR starts_with(bare, '[') THEN bare WHEN {listed(3)} THEN {tail(3 + one)} WHEN {listed(2)} THEN {tail(2 + one)} ELSE {tail(1 + one)} END"
    fits = [f"WHEN (host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}) THEN " for _, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))]
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    rule, verdict = ("CASE " + " ".join(f + quote(h + p if what == "rule" else kind) for f, (kind, h, p) in zip(fits, ordered)) + " END" for what in ("rule", "verdict"))
    weight = lambda table, m: f"(SELECT CASE WHEN x > 0 THEN least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, v / x - 1)) ELSE {MOST_WEIGHT} END FROM (SELECT avg(round({m} * (1 - {m}), 9)::DECIMAL(20, 9))::DOUBLE AS v, avg(round((bad / n - {m}) * (bad / n - {m}) - {m} * (1 - {m}) / n, 9)::DECIMAL(20, 9))::DOUBLE AS x FROM {table} WHERE n >= 2))"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
b AS (SELECT *, {bare} AS bare, string_split({bare}, '.') AS ps FROM c),
hosts AS (SELECT host, n, bad, {by(0)} AS suffix, {by(1)} AS domain FROM b),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM hosts) AS m0 FROM domains GROUP BY suffix),
s AS (SELECT suffix, (bad + k * m0) / (n + k) AS m1 FROM suffixes, (SELECT {weight('suffixes', 'm0')} AS k)),
d0 AS (SELECT * FROM domains JOIN s USING (suffix)),
d AS (SELECT suffix, domain, (bad + k * m1) / (n + k) AS m2 FROM d0, (SELECT {weight('d0', 'm1')} AS k)),
h0 AS (SELECT * FROM hosts JOIN d USING (suffix, domain)),
h AS (SELECT host, n, k, (bad + k * m2) / (n + k) AS m3 FROM h0, (SELECT {weight('h0', 'm2')} AS k)),
r AS (SELECT host, m3, m3 - {Z} * sqrt(m3 * (1 - m3) / (n + k + 1)) AS low FROM h)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN low > {threshold} THEN 'block' ELSE 'allow' END) AS verdict, round(m3, 6) AS posterior_mean, round(low, 6) AS lower_bound FROM p LEFT JOIN r USING (host)
"""
