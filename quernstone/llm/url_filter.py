"""URL filters: explicit host/path rules, and a path-template tree for the rest.

Per host, each path becomes a template: segments that are numbers, hexadecimal names,
names with digits or very long become wildcards that keep the file ending; beyond
``DEPTH`` segments stands ``**``. The templates, with their counts of labelled pages,
form a tree by host, much smaller than the pages. On it, level by level,

* a node with more than ``FAN_OUT`` different literal children makes them one ``*``;
* literal siblings that have labelled pages, with equal continuation, merge into ``*`` if
  no child's share of blocked pages among its labelled ones differs significantly from
  that of all together (two-proportion test). A branch without labels stays as it is:
  nothing is known against it, so it is allowed.

A template is rejected if it has ``MIN_LABELS`` labelled pages and its purity, smoothed
towards its host's, which is smoothed towards the corpus', reaches ``PURITY``.
Labels come from the rules, or from a column of the caller's.

DataFrame functions only. Hosts with very many templates are spread in the tree's joins;
pages meet the tree in one equi-join on (host, template,
salt), salted because one host can own a third of all pages.

Edge cases: a url that is null or has no ``://`` has empty host and path and fits no
rule; an empty path fits no rule; of rules of equal length the first in alphabetical
order wins; repeated pages are judged one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read, spread_join, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEPTH, FAN_OUT, Z, ALPHA, MIN_LABELS, PURITY, SALTS = 4, 50, 3.0, 4.0, 10, 0.8, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = url.contains("://")
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    bare = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(bare, r"(?s)^[^/]*", 0)
    return (
        F.when(known, F.translate(host, UPPER, LOWER)).otherwise(F.lit("")),
        F.when(known, F.substring(bare, F.length(host) + 1, F.length(bare))).otherwise(F.lit("")),
    )


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], part: int | None) -> Column:
    """Of the longest rule that fits: its text (``part`` None) or that part of it."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(rule[1] + rule[2] if part is None else rule[part])).otherwise(out)
    return out


def template(path: Column) -> Column:
    """Array of at most DEPTH + 1 segments; wildcards begin with ``{``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.substring(s, F.lit(1), F.length(s) - F.length(ending))
        return (
            F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), ending))
            .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{h}"), ending))
            .when(stem.rlike(r"[0-9]"), F.concat(F.lit("{x}"), ending))
            .when((F.length(stem) > 40) | stem.startswith("{") | stem.startswith("*"), F.concat(F.lit("{l}"), ending))
            .otherwise(s)
        )

    head = F.transform(F.slice(segments, 1, DEPTH), shape)
    return F.when(F.size(segments) > DEPTH, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def put(array: Column, at: int, value: Column) -> Column:
    return F.transform(array, lambda s, i: F.when(i == at - 1, value).otherwise(s))


def literal(segment: Column) -> Column:
    return segment.isNotNull() & ~segment.startswith("{") & ~segment.startswith("*")


def tree(leaves: DataFrame, depth: int = DEPTH, fan_out: int = FAN_OUT, z: float = Z) -> DataFrame:
    """``leaves`` (host, leaf, n, blocked, allowed; one row per host and leaf) with
    ``node``: the leaf's template after generalising and merging."""
    rows, count = leaves.withColumn("node", F.col("leaf")), leaves.count()

    def meet(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
        return spread_join(rows, facts, keys, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), by="leaf", how="left")

    for d in range(1, depth + 1):
        child = F.get("node", F.lit(d - 1))
        up = F.slice("node", 1, d - 1)
        kinds = rows.where(literal(child)).select("host", up.alias("up"), child.alias("child")).distinct()
        wide = written(kinds.groupBy("host", "up").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > fan_out), "url-wide", count)
        rows = meet(rows.withColumn("up", up), wide, ["host", "up"])
        rows = rows.withColumn("node", F.when(F.col("kinds").isNotNull() & literal(child), put(F.col("node"), d, F.lit("*"))).otherwise(F.col("node"))).drop("up", "kinds")
        rows = written(rows, "url-tree", count)
    for d in range(1, depth + 1):
        child = F.get("node", F.lit(d - 1))
        blank = F.when(literal(child), put(F.col("node"), d, F.lit("*")))
        kids = rows.where(literal(child)).groupBy("host", blank.alias("blank"), child.alias("child")).agg(F.sum("blocked").alias("b"), (F.sum("blocked") + F.sum("allowed")).alias("l")).where("l > 0")
        whole = kids.groupBy("host", "blank").agg(F.sum("b").alias("wb"), F.sum("l").alias("wl"), F.count(F.lit(1)).alias("kids"))
        p = (F.col("wb") + 1) / (F.col("wl") + 2)
        far = F.abs(F.col("b") / F.col("l") - F.col("wb") / F.col("wl")) > z * F.sqrt(p * (1 - p) * (1 / F.col("l") + 1 / F.col("wl")))
        judged = kids.join(whole, ["host", "blank"])
        alike = judged.groupBy("host", "blank").agg(F.max("kids").alias("kids"), F.max(far.cast("int")).alias("odd")).where("kids > 1 and odd = 0").select("host", "blank")
        merged = written(kids.join(alike, ["host", "blank"]).select("host", "blank", "child", F.lit(True).alias("merged")), "url-merged", count)
        rows = meet(rows.withColumns({"blank": blank, "child": child}), merged, ["host", "blank", "child"])
        rows = rows.withColumn("node", F.when(F.col("merged"), F.col("blank")).otherwise(F.col("node"))).drop("blank", "child", "merged")
        rows = written(rows, "url-tree", count)
    return rows


def rejected(rows: DataFrame, alpha: float = ALPHA, min_labels: int = MIN_LABELS, purity: float = PURITY) -> DataFrame:
    """(host, leaf) of ``tree`` whose node is rejected, with the node's purity."""
    b, a = F.sum("blocked"), F.sum("allowed")
    base = rows.agg((b + 1) / (b + a + 2)).first()[0] or 0.5
    hosts = rows.groupBy("host").agg(b.alias("hb"), (b + a).alias("hl")).select("host", ((F.col("hb") + alpha * base) / (F.col("hl") + alpha)).alias("prior"))
    nodes = rows.groupBy("host", "node").agg(b.alias("nb"), (b + a).alias("nl")).join(hosts, "host")
    nodes = nodes.withColumn("purity", (F.col("nb") + alpha * F.col("prior")) / (F.col("nl") + alpha)).where((F.col("nl") >= min_labels) & (F.col("purity") >= purity))
    return rows.join(nodes.select("host", "node", "purity"), ["host", "node"]).select("host", "leaf", "node", "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template. ``label``: an integer column of
    ``pages``, 1 blocked, 0 allowed, null unknown; by default the rules label."""
    host, path = host_and_path(F.col("url"))
    mark = F.col(label) if label else F.lit(None).cast("int")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), mark.alias("mark"))
    own = rule_of(F.col("host"), F.col("path"), rules, 0)
    parts = parts.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, None), "own": own, "leaf": template(F.col("path"))})
    parts = parts.withColumn("mark", F.coalesce("mark", (F.col("own") == "block").cast("int")) if label is None else F.col("mark"))
    leaves = parts.groupBy("host", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("mark") == 1).alias("blocked"), F.count_if(F.col("mark") == 0).alias("allowed")
    )
    bad = written(rejected(tree(written(leaves, "url-leaves"))), "url-rejected")
    salted = bad.select("host", "leaf", "node", "purity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return (
        parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
        .join(salted, ["host", "leaf", "salt"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("purity").isNotNull(), "block").otherwise("allow")).alias("verdict"))
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def oracle() -> str:
    """The query in SQL: the tree's levels are spelled out one after the other."""
    case = "".join(f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then struct_pack(r := '{h}{p}', v := '{v}')" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    stem = "substr(s, 1, length(s) - length(regexp_extract(s, '(\\.[A-Za-z]{1,5})$', 1)))"
    ending = "regexp_extract(s, '(\\.[A-Za-z]{1,5})$', 1)"
    shape = f"""case when regexp_matches({stem}, '^[0-9]+$') then '{{n}}' || {ending} when regexp_matches({stem}, '^[0-9a-fA-F-]{{8,}}$') then '{{h}}' || {ending}
      when regexp_matches({stem}, '[0-9]') then '{{x}}' || {ending} when length({stem}) > 40 or {stem}[1] in ('{{', '*') then '{{l}}' || {ending} else s end"""
    sql = [
        "a as (select page_id, contains(url, '://') as known, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') as bare from pages)",
        f"b as (select page_id, coalesce(case when known then translate(regexp_extract(bare, '^[^/]*'), '{UPPER}', '{LOWER}') end, '') as host, coalesce(case when known then substr(bare, length(regexp_extract(bare, '^[^/]*')) + 1) end, '') as path from a)",
        f"c as (select *, case{case} end as fit, list_filter(string_split(path, '/'), lambda s: s <> '') as segs from b)",
        f"d as (select page_id, host, path, fit.r as rule, fit.v as own, list_concat(list_transform(segs[1:{DEPTH}], lambda s: {shape}), case when len(segs) > {DEPTH} then ['**'] else [] end) as leaf from c)",
        "t0 as (select host, leaf, leaf as node, count(*) as n, count(*) filter (where own = 'block') as b, count(*) filter (where own = 'allow') as a from d group by host, leaf)",
    ]
    at = 0
    for k in range(1, DEPTH + 1):
        lit = f"(node[{k}] is not null and node[{k}][1] not in ('{{', '*'))"
        star = f"list_transform(node, lambda s, i: case when i = {k} then '*' else s end)"
        sql += [
            f"w{at} as (select host, node[1:{k - 1}] as up from t{at} where {lit} group by host, up having count(distinct node[{k}]) > {FAN_OUT})",
            f"t{at + 1} as (select t.host, leaf, case when w.host is not null and {lit} then {star} else node end as node, n, b, a from t{at} t left join w{at} w on w.host = t.host and w.up = t.node[1:{k - 1}])",
        ]
        at += 1
    for k in range(1, DEPTH + 1):
        lit = f"(node[{k}] is not null and node[{k}][1] not in ('{{', '*'))"
        star = f"list_transform(node, lambda s, i: case when i = {k} then '*' else s end)"
        p = "((wb + 1) / (wl + 2.0::double))"
        far = f"abs(b / l::double - wb / wl::double) > {Z} * sqrt({p} * (1 - {p}) * (1 / l::double + 1 / wl::double))"
        sql += [
            f"k{at} as (select host, {star} as blank, node[{k}] as child, sum(b) as b, sum(b) + sum(a) as l from t{at} where {lit} group by all having sum(b) + sum(a) > 0)",
            f"s{at} as (select *, sum(b) over w as wb, sum(l) over w as wl, count(*) over w as kids from k{at} window w as (partition by host, blank))",
            f"m{at} as (select host, blank from s{at} group by host, blank having max(kids) > 1 and not bool_or({far}))",
            f"c{at} as (select k.host, k.blank, k.child from k{at} k join m{at} m on k.host = m.host and k.blank = m.blank)",
            f"t{at + 1} as (select t.host, leaf, case when c.host is not null then c.blank else node end as node, n, b, a from t{at} t left join c{at} c on c.host = t.host and c.blank = {star} and c.child = t.node[{k}] and {lit})",
        ]
        at += 1
    sql += [
        f"base as (select (sum(b) + 1) / (sum(b) + sum(a) + 2.0::double) as p from t{at})",
        f"prior as (select host, (sum(b) + {ALPHA}::double * any_value(p)) / (sum(b) + sum(a) + {ALPHA}::double) as prior from t{at}, base group by host)",
        f"bad as (select host, node from t{at} join prior using (host) group by host, node having sum(b) + sum(a) >= {MIN_LABELS} and (sum(b) + {ALPHA}::double * any_value(prior)) / (sum(b) + sum(a) + {ALPHA}::double) >= {PURITY})",
        f"gone as (select host, leaf from t{at} join bad using (host, node))",
    ]
    return f"with {', '.join(sql)} select page_id, d.host, d.path, rule, coalesce(own, case when gone.host is not null then 'block' else 'allow' end) as verdict from d left join gone on gone.host = d.host and gone.leaf = d.leaf"
