"""URL filter by a path-template tree for each host.

Level by level a path's segment becomes a branch or the wildcard ``*``. A segment is a branch only if enough URLs have it and the share of bad
pages under it differs from its parent's by more than chance, so segments that vary (numbers, names) become the wildcard by their counts.
Branches of one node whose shares are alike are merged: shares are compared on the arcsine scale, where their deviation depends on counts
alone, in cells of ``ALIKE``; a merged branch is named by its first segment and how many more it has (``a#2``). A template is
rejected if its smoothed share of bad labelled pages is high. Explicit rules on hosts and paths come first. Below the third level a
branch grows as long as ``LEAST_URLS`` of its URLs go on, to the deepest path; what is below a smaller one is ``/**``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_join, hot_split, stored

#: (verdict, host and path): a rule fits its host and all subdomains, and paths that start with its path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LEVELS, LEAST_URLS, SMOOTHING, Z, ALIKE, REJECT = 3, 8, 4.0, 1.64, 0.2, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct of the longest fitting rule (rule, verdict), or null. Of equally long ones the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _rate(bad, labelled, prior) -> Column:
    return (bad + SMOOTHING * prior) / (labelled + SMOOTHING)


def _subtree(paths: list[list[str]], sums: list[tuple[int, int, int]], level: int, template: str, prior: float) -> list[str]:
    """Templates of all paths (``sums``: n, labelled, bad_n) below one node, by the rule of ``template_verdicts`` from ``level`` on."""
    out, todo = [""] * len(paths), [(template, level, list(range(len(paths))))]
    while todo:
        name, at, members = todo.pop()
        going = []
        for k in members:
            if len(paths[k]) > at:
                going.append(k)
            else:
                out[k] = name
        if sum(sums[k][0] for k in going) < LEAST_URLS:
            for k in going:
                out[k] = f"{name}/**"
            continue
        children: dict[str, list[int]] = {}
        for k in going:
            own = children.setdefault(paths[k][at], [0, 0, 0])
            for j in range(3):
                own[j] += sums[k][j]
        rate = (sum(c[2] for c in children.values()) + SMOOTHING * prior) / (sum(c[1] for c in children.values()) + SMOOTHING)
        alike: dict[int, list[str]] = {}
        for segment, (n, labelled, bad) in children.items():
            own = (bad + SMOOTHING * rate) / (labelled + SMOOTHING)
            if n >= LEAST_URLS and segment not in ("*", "**") and abs(own - rate) > Z * math.sqrt(rate * (1 - rate) / (labelled + SMOOTHING)):
                alike.setdefault(math.floor(math.asin(math.sqrt(own)) / ALIKE), []).append(segment)
        branch = {}
        for segments in alike.values():
            first = min(segments, key=str.encode)
            branch |= dict.fromkeys(segments, first if len(segments) == 1 else f"{first}#{len(segments) - 1}")
        grown: dict[str, list[int]] = {}
        for k in going:
            grown.setdefault(branch.get(paths[k][at], "*"), []).append(k)
        todo += [(f"{name}/{b}", at + 1, own) for b, own in grown.items()]
    return out


def _small_subtrees(tree: DataFrame, level: int, prior: float) -> DataFrame:
    """``tree`` with the templates of whole subtrees; each node's rows (few enough) meet in one task, and are held one node at a time."""
    names = ["host", "template", "segments", "n", "labelled", "bad_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(node: tuple, held: list[tuple]) -> pa.RecordBatch:
            segments, *sums = zip(*held)
            templates = _subtree(list(segments), list(zip(*sums)), level, node[1], prior)
            columns = [[node[0]] * len(held), templates, list(segments), *map(list, sums)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()))], names)

        node, held = None, []
        for batch in batches:
            for host, template, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, template) != node:
                    if held:
                        yield solved(node, held)
                    node, held = (host, template), []
                held.append(tuple(row))
        if held:
            yield solved(node, held)

    types = "host string, template string, segments array<string>, n long, labelled long, bad_n long"
    dealt = tree.select(*names).repartition("host", "template").sortWithinPartitions("host", "template")
    return dealt.mapInArrow(run, types).select(*tree.columns)


def template_verdicts(urls: DataFrame, whole: int = 1_000_000) -> DataFrame:
    """Columns of ``urls`` (host, path, bad: 1, 0 or null) with template, template_rate and method (allow or block).

    All counts are sums by (host, template so far, segment), and the few nodes, templates and paths that have many rows are joined by broadcast
    (``hot_join``), so a host or a URL with a third of all rows is no large group. Below the third level a node with at most ``whole`` segments left under it is
    solved in one task, to the deepest path; only nodes with more cost a round of jobs a level.
    """
    count = (F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_n"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    df = stored(urls, "url-rows").withColumn("segments", segments)
    paths = df.withColumn("template", F.lit("")).groupBy("host", "segments", "template").agg(*count)
    overall = df.agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_n")).first()
    prior = (overall["bad_n"] + 1.0) / (overall["labelled"] + 2.0)
    # one row for each distinct host and path from here on
    paths = stored(paths, "url-paths")
    sums = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad_n").alias("bad_n"))
    rows = F.count("*").alias("rows")

    def grow(tree: DataFrame, level: int) -> DataFrame:
        tree = tree.withColumn("segment", F.get("segments", level))
        children = stored(tree.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums, rows), "url-children")
        parents = children.groupBy("host", "template").agg(F.sum("labelled").alias("pl"), F.sum("bad_n").alias("pb"), rows)
        parents = parents.select("host", "template", _rate(F.col("pb"), F.col("pl"), prior).alias("rate"), "rows")
        own = _rate(F.col("bad_n"), F.col("labelled"), F.col("rate"))
        apart = F.abs(own - F.col("rate")) > Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("labelled") + SMOOTHING))
        enough = children.filter((F.col("n") >= LEAST_URLS) & ~F.col("segment").isin("*", "**"))
        stay = hot_join(enough, *hot_split(parents, "rows"), ["host", "template"]).filter(apart)
        stay = stay.withColumn("alike", F.floor(F.asin(F.sqrt(own)) / ALIKE))
        merged = stay.groupBy("host", "template", "alike").agg(F.min("segment").alias("first"), F.count("*").alias("many"))
        name = F.when(F.col("many") == 1, F.col("first")).otherwise(F.concat("first", F.lit("#"), F.col("many") - 1))
        merged = merged.select("host", "template", "alike", name.alias("branch"), "many")
        branches = hot_join(stay.select("host", "template", "segment", "alike"), *hot_split(merged, "many"), ["host", "template", "alike"]).drop("alike")
        # every segment with its branch or none: the most frequent ones must not gather in one task
        named = stored(children.select("host", "template", "segment", "rows").join(branches, ["host", "template", "segment"], "left"), "url-names")
        grown = hot_join(tree.filter("segment IS NOT NULL"), *hot_split(named, "rows"), ["host", "template", "segment"])
        grown = grown.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))).drop("branch")
        return stored(grown.unionByName(tree.filter("segment IS NULL")).drop("segment"), "url-level")

    tree, done = paths, []
    for level in range(LEVELS):
        tree = grow(tree, level)
    # deeper levels only where enough URLs go on; a branch with fewer could not stay below either
    level = LEVELS
    while True:
        done.append(tree.filter(F.size("segments") <= level))
        going = tree.filter(F.size("segments") > level)
        nodes = going.groupBy("host", "template").agg(F.sum("n").alias("going"), F.sum(F.size("segments") - level).alias("left"), rows)
        split = stored(hot_join(going, *hot_split(nodes, "rows"), ["host", "template"]), "url-level")
        done.append(split.filter(F.col("going") < LEAST_URLS).withColumn("template", F.concat("template", F.lit("/**"))).drop("going", "left"))
        done.append(_small_subtrees(split.filter((F.col("going") >= LEAST_URLS) & (F.col("left") <= whole)).drop("going", "left"), level, prior))
        tree = split.filter((F.col("going") >= LEAST_URLS) & (F.col("left") > whole)).drop("going", "left")
        if tree.isEmpty():
            break
        tree, level = grow(tree, level), level + 1
    tree = done.pop()
    for piece in done:
        tree = tree.unionByName(piece)
    tree = stored(tree, "url-tree")
    leaves = stored(tree.groupBy("host", "template").agg(*sums, F.count("*").alias("paths")), "url-leaves")
    hosts = leaves.groupBy("host").agg(*sums, rows).select("host", _rate(F.col("bad_n"), F.col("labelled"), prior).alias("host_rate"), "rows")
    leaves = hot_join(leaves, *hot_split(hosts, "rows"), "host").withColumn("template_rate", _rate(F.col("bad_n"), F.col("labelled"), F.col("host_rate")))
    judged = stored(leaves.select("host", "template", "template_rate", F.when(F.col("template_rate") >= REJECT, "block").otherwise("allow").alias("method"), "paths"), "url-judged")
    by_path = stored(hot_join(tree.select("host", "segments", "template", "n"), *hot_split(judged, "paths"), ["host", "template"]), "url-verdicts")
    return hot_join(df, *hot_split(by_path, "n"), ["host", "segments"]).drop("segments")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_rate for every row of ``pages`` (page_id, url).

    ``labels`` (page_id, bad 0 or 1): labelled pages; of several labels of a page the worst counts, and a page without one is not labelled.
    A null url, or one without ``://``, has an empty host and path; very long paths grow as deep as their branches have URLs. Repeated rows stay, further
    columns are not read, and an empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    worst = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    judged = template_verdicts(rows.join(worst, "page_id", "left")).withColumn("found", match_rules(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "method").alias("verdict"), "template", F.round("template_rate", 9).alias("template_rate"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's number in its path is the id of the document that it shows; bad: low quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})", 1)
    bad = labels.select("doc_id", F.greatest(1 - F.col("quality"), F.col("toxic")).cast("int").alias("bad")).filter("bad IS NOT NULL")
    return pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).join(bad, "doc_id").select("page_id", "bad")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return filter_urls(pages.select("page_id", "url"), page_labels(pages, labels))


def oracle() -> str:
    sums = "sum(n) AS n, sum(labelled) AS labelled, sum(bad_n) AS bad_n"
    rate = lambda b, l, p: f"(({b}) + {SMOOTHING} * ({p})) / (({l}) + {SMOOTHING})"
    def case(part: int) -> str:
        whens = []
        for r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
            name, path = r[1].split("/", 1)
            whens.append(f"WHEN (u.host = '{name}' OR ends_with(u.host, '.{name}')) AND starts_with(u.path, '/{path}') THEN '{r[part]}'")
        return f"CASE {' '.join(whens)} END"

    sql = f"""WITH cut AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS host0, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
split AS (SELECT page_id, translate(host0, '{_UPPER}', '{_LOWER}') AS host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, nullif(regexp_extract(path, '([0-9]{{1,18}})', 1), '') AS number FROM cut),
lab AS (SELECT page_id, max(greatest(1 - quality, toxic)) AS bad FROM split JOIN labels ON CAST(number AS BIGINT) = doc_id WHERE greatest(1 - quality, toxic) IS NOT NULL GROUP BY page_id),
u AS (SELECT split.*, bad FROM split LEFT JOIN lab USING (page_id)),
prior AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (count(bad) + 2.0) AS g FROM u),
t0 AS (SELECT host, segments, '' AS template, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad_n FROM u GROUP BY host, segments)"""
    for k in range(LEVELS):
        sql += f""",
s{k} AS (SELECT *, segments[{k + 1}] AS segment FROM t{k}),
c{k} AS (SELECT host, template, segment, {sums} FROM s{k} WHERE segment IS NOT NULL GROUP BY host, template, segment),
p{k} AS (SELECT host, template, {rate("sum(bad_n)", "sum(labelled)", "any_value(g)")} AS rate FROM c{k}, prior GROUP BY host, template),
b{k} AS (SELECT host, template, segment, floor(asin(sqrt({rate("bad_n", "labelled", "rate")})) / {ALIKE}) AS alike FROM c{k} JOIN p{k} USING (host, template) WHERE n >= {LEAST_URLS} AND segment NOT IN ('*', '**') AND abs({rate("bad_n", "labelled", "rate")} - rate) > {Z} * sqrt(rate * (1 - rate) / (labelled + {SMOOTHING}))),
m{k} AS (SELECT host, template, alike, CASE WHEN count(*) = 1 THEN min(segment) ELSE min(segment) || '#' || (count(*) - 1) END AS branch FROM b{k} GROUP BY host, template, alike),
k{k} AS (SELECT b{k}.host, b{k}.template, segment, branch FROM b{k} JOIN m{k} ON b{k}.host = m{k}.host AND b{k}.template = m{k}.template AND b{k}.alike = m{k}.alike),
t{k + 1} AS (SELECT s{k}.host, segments, s{k}.template || CASE WHEN s{k}.segment IS NULL THEN '' ELSE '/' || coalesce(branch, '*') END AS template, n, labelled, bad_n FROM s{k} LEFT JOIN k{k} ON s{k}.host = k{k}.host AND s{k}.template = k{k}.template AND s{k}.segment = k{k}.segment)"""
    return sql + f""",
tree AS (SELECT host, segments, template || CASE WHEN len(segments) > {LEVELS} THEN '/**' ELSE '' END AS template, n, labelled, bad_n FROM t{LEVELS}),
hosts AS (SELECT host, {rate("sum(bad_n)", "sum(labelled)", "any_value(g)")} AS host_rate FROM tree, prior GROUP BY host),
leaves AS (SELECT tree.host, template, {rate("sum(bad_n)", "sum(labelled)", "any_value(host_rate)")} AS r FROM tree JOIN hosts ON tree.host = hosts.host GROUP BY tree.host, template)
SELECT u.page_id, u.host, u.path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN r >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, tree.template, round(r, 9) AS template_rate
FROM u JOIN tree ON u.host = tree.host AND u.segments = tree.segments JOIN leaves ON tree.host = leaves.host AND tree.template = leaves.template"""
