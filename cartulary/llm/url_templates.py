"""URL filter by path templates. DataFrame and SQL functions only.

Per host a tree of path segments. Numbers and long hexadecimal tokens are variable at once. At each node the literal branches with enough rows are
tested against the rest of their siblings (two-proportion z test on labelled rows, the threshold raised for the number of branches tested).
Those that differ upwards, and those that differ downwards, are tested once more among themselves; branches that come out alike are merged and
share one subtree, and all that do not differ, or are too rare, are merged into one wildcard. The tree goes down as long as a test could still find
something: a node with few rows, or with labels of one kind, ends in `**`. A template is rejected by its share of bad labelled rows, smoothed towards
its parent's (and so up to the whole table's). Rules of (host, path prefix) go before the tree; the longest that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, write_table

#: Segments told apart; the rest of a longer path is one more segment, as it stands.
DEPTH = 32
SUPPORT = 20
Z = 1.96
SMOOTHING = 10.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, else nulls. A rule `host/path` fits the host and its subdomains where the path starts with its own."""
    verdict, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        verdict, found = F.when(fits, action).otherwise(verdict), F.when(fits, rule).otherwise(found)
    return verdict, found


def segments(path: str, depth: int) -> Column:
    """The segments, variable tokens generalised; those after the first `depth` are joined to one."""
    general = lambda s: F.regexp_replace(F.regexp_replace(s, "^[0-9a-fA-F-]{16,}$", "{h}"), "[0-9]+", "{n}")
    all_of = F.transform(F.filter(F.split(F.col(path), "/"), lambda s: s != ""), general)
    rest = F.array_join(F.slice(all_of, depth + 1, F.greatest(F.size(all_of) - depth, F.lit(0))), "/")
    return F.when(F.size(all_of) > depth, F.concat(F.slice(all_of, 1, depth), F.array(rest))).otherwise(all_of)


def smooth(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + F.lit(SMOOTHING) * prior) / (labelled + F.lit(SMOOTHING))


def side(bad: str, labelled: str, all_bad: str, all_labelled: str, tests: str, z: float) -> Column:
    """`+` or `-` where a branch's share of bad rows differs from that of the rest of `all`, else empty; z squared grows by 2 ln(tests)."""
    b, n, rest_b, rest_n = F.col(bad), F.col(labelled), F.col(all_bad) - F.col(bad), F.col(all_labelled) - F.col(labelled)
    rate = F.col(all_bad) / F.col(all_labelled)
    gap = b / n - rest_b / rest_n
    differs = gap * gap >= (F.lit(z * z) + 2 * F.ln(F.col(tests))) * rate * (1 - rate) * (1 / n + 1 / rest_n)
    known = (rest_n > 0) & (F.col(all_bad) > 0) & (F.col(all_bad) < F.col(all_labelled))
    return F.when(F.when(known, differs).otherwise(F.lit(False)), F.when(gap > 0, "+").otherwise("-")).otherwise("")


def branches(kids: DataFrame, nodes: DataFrame, support: int, z: float) -> tuple[DataFrame | None, DataFrame]:
    """(node, seg, branch, b_labelled, b_bad) of the kids (node, seg, n, labelled, bad) that differ (None where none does), and nodes with what is left to their wildcard."""
    single = (F.col("kids") == 1).alias("single")
    able = kids.where((F.col("n") >= support) & (F.col("labelled") > 0)).join(nodes.where("not settled").hint("merge"), "node")
    able = write_table(able.select("node", "seg", "labelled", "bad", "w_labelled", "w_bad"), "able")
    tests = able.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("tests"))
    first = able.join(tests.hint("merge"), "node").withColumn("side", side("bad", "labelled", "w_bad", "w_labelled", "tests", z)).where("side <> ''")
    first = write_table(first.select("node", "seg", "labelled", "bad", "side"), "first")
    if first.isEmpty():
        return None, nodes.select("node", "paths", "settled", F.lit(True).alias("whole"), single, F.col("w_labelled").alias("r_labelled"), F.col("w_bad").alias("r_bad"))
    sums = first.groupBy("node", "side").agg(F.sum("labelled").alias("s_labelled"), F.sum("bad").alias("s_bad"), F.count(F.lit(1)).cast("double").alias("s_tests"))
    second = first.join(sums.hint("merge"), ["node", "side"]).withColumn("side", F.concat("side", side("bad", "labelled", "s_bad", "s_labelled", "s_tests", z)))
    second = write_table(second.select("node", "seg", "labelled", "bad", "side"), "second")
    merged = second.groupBy("node", "side").agg(F.sum("labelled").alias("b_labelled"), F.sum("bad").alias("b_bad"), F.count(F.lit(1)).alias("together"))
    found = second.join(merged.hint("merge"), ["node", "side"]).select("node", "seg", F.when(F.col("together") == 1, F.col("seg")).otherwise(F.concat(F.lit("*"), "side")).alias("branch"), "b_labelled", "b_bad")
    taken = second.groupBy("node").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"), F.count(F.lit(1)).alias("t_kids"))
    left = nodes.join(taken.hint("merge"), "node", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = left.select("node", "paths", "settled", (none("t_kids") == 0).alias("whole"), single, (F.col("w_labelled") - none("t_labelled")).alias("r_labelled"), (F.col("w_bad") - none("t_bad")).alias("r_bad"))
    return found, left


def templates(rows: DataFrame, depth: int = DEPTH, support: int = SUPPORT, z: float = Z) -> tuple[DataFrame, int]:
    """(host, segs, n, template, purity) for each distinct (host, segs) of rows with `bad` (1, 0, null: not labelled), and the number of rows."""
    t = write_table(rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "paths")
    a = t.agg(F.sum("n").alias("n"), F.sum("bad").alias("b"), F.sum("labelled").alias("l"), F.count(F.lit(1)).alias("paths")).first()
    overall = (a.b or 0) / a.l if a.l else 0.0
    hosts = t.groupBy(F.col("host").alias("h")).agg(smooth(F.sum("bad"), F.sum("labelled"), F.lit(overall)).alias("purity"), F.count(F.lit(1)).alias("paths"))
    t = join_hot(t, write_table(hosts, "hosts"), [("host", "h")], "paths", a.paths).select("host", "segs", "n", "labelled", "bad", "purity", F.col("host").alias("node"))
    done, now, total = [], write_table(t, "level"), a.paths
    for d in range(depth + 2):  # a path has at most depth + 1 segments, and its end
        if not total:
            break
        now = now.withColumn("seg", F.coalesce(F.get("segs", F.lit(d)), F.lit("$")))
        kids = now.groupBy("node", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")], F.count(F.lit(1)).alias("paths"))
        kids = write_table(kids, f"kids{d}")
        nodes = kids.groupBy("node").agg(F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"w_{c}") for c in ("n", "labelled", "bad")])
        nodes = write_table(nodes.withColumn("settled", (F.col("w_bad") == 0) | (F.col("w_bad") == F.col("w_labelled")) | (F.col("w_n") < 2 * support)), f"nodes{d}")
        if nodes.where("not settled").isEmpty():
            done.append(now.select("host", "segs", "n", F.concat("node", F.lit("/**")).alias("template"), "purity"))
            break
        found, left = branches(kids, nodes, support, z)
        left = write_table(left.toDF(*[f"l_{c}" for c in left.columns]), f"left{d}")
        t = join_hot(now, left, [("node", "l_node")], "l_paths", total)
        if found is None:
            t = t.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("f_branch", "string"), ("f_b_labelled", "long"), ("f_b_bad", "long"))])
        else:
            found = found.join(kids.select("node", "seg", "paths").hint("merge"), ["node", "seg"])
            found = write_table(found.toDF(*[f"f_{c}" for c in found.columns]), f"found{d}")
            t = join_hot(t, found, [("node", "f_node"), ("seg", "f_seg")], "f_paths", total, "left")
        own, of = F.col("f_branch").isNotNull(), lambda f, r: F.coalesce(F.col(f), F.col(r))
        branch = F.when(own, F.col("f_branch")).when(F.col("l_single"), F.col("seg")).otherwise("*")
        node = F.when(F.col("l_settled"), F.concat("node", F.lit("/**"))).otherwise(F.concat_ws("/", "node", branch))
        # a branch with all rows of its node brings no new evidence
        purity = F.when(F.col("l_settled") | F.col("l_whole"), F.col("purity")).otherwise(smooth(of("f_b_bad", "l_r_bad"), of("f_b_labelled", "l_r_labelled"), F.col("purity")))
        t = t.select("host", "segs", "n", "labelled", "bad", purity.alias("purity"), node.alias("node"), (~F.col("l_settled") & (F.col("seg") != "$")).alias("open"))
        t = write_table(t, f"level{d}")
        done.append(t.where("not open").select("host", "segs", "n", F.regexp_replace("node", r"/\$$", "").alias("template"), "purity"))
        now = t.where("open").drop("open")
        total = now.count()
    out = done[0] if done else t.select("host", "segs", "n", F.col("node").alias("template"), "purity")
    for more in done[1:]:
        out = out.unionByName(more)
    return write_table(out, "templates"), a.n or 0


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = (), id_col: str = "page_id", url: str = "url", depth: int = DEPTH, support: int = SUPPORT, z: float = Z, reject: float = REJECT) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for each row; labels are (id, bad) with bad 1 or 0; of several labels of an id the worst counts.

    A null url, or one without ://, has empty host and path and a template of its own. Rows without a label, or without an id, shape the tree but no
    purity; without any labels nothing is rejected. Paths of any length are read whole; segments after the first `depth` stand as one. Repeated rows
    count each; equal rates are no difference; extra columns, also of the result's names, are ignored; an empty table gives an empty result.
    """
    host, path = parse(url)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("segs", segments("path", depth))
    worst = labels.where("id is not null and bad is not null").groupBy(F.col("id").alias("lid")).agg(F.max("bad").cast("long").alias("bad"))
    worst = write_table(worst, "url_labels")
    t, total = templates(rows.join(worst.hint("merge"), F.col("id") == F.col("lid"), "left"), depth, support, z)
    t = t.select(F.col("host").alias("th"), F.col("segs").alias("ts"), F.col("n").alias("tn"), "template", "purity")
    verdict, rule = rule_of(F.col("host"), F.col("path"), list(rules))
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    out = join_hot(rows, t, [("host", "th"), ("segs", "ts")], "tn", total)
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
