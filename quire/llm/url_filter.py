"""URL filter: hand-written rules, then a path-template tree for each host. DataFrame functions only.

1. A url is cut into host and path; the longest rule that fits decides.
2. Paths become shapes, lists of segments: digit runs are ``#``, long hexadecimal segments ``{hex}``, runs of equal segments one
   with ``+`` behind it; a slash at the end doesn't matter. Urls are counted by (host, shape) with how many a rule blocks or
   allows: these are the labels.
3. The tree of a host's shapes is built from the root, level by level. Among the children of a branch a segment is variable
   where there are more than ``FEW`` and it holds less than ``SHARE`` of the branch's urls: it turns into ``*``, and what
   stands below all variable segments is pooled before the next level is decided. A branch keeps at most ``FEW`` + 1 / ``SHARE``
   + 2 children.
4. Children are merged into branches: labelled ones whose shares of blocked urls don't differ by a two-proportion z test; one
   without labels joins the labelled branch that has the forms (segments with their letters left out) of most of its urls, if
   that is the share ``ALIKE`` of them. The next level is that of the merged branch.
5. A branch's purity is its blocked share, smoothed by ``ALPHA`` labels towards its parent's purity, and so on up to the host and to all
   labels. A template is rejected if its branch has ``MIN_LABELS`` labels and the purity is at least ``REJECT``.

What a branch has in common is skipped at once, and a branch of one shape is finished: there are as many rounds as branchings on
a path, not as segments. Counts are taken before every shuffle and joins on branches are salted: a host may hold a third of all urls.

Defined cases: a url that is null or has no ``://`` has empty host and path (shape ''); an empty path has shape ''; a tie between
labelled branches goes to the one of lesser purity, then to the first by name; equal urls give equal rows; very long and deep
urls are urls as others; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import durable, forget, salted_join

FEW = 8
SHARE = 0.05
ALIKE = 0.5
ALPHA = 4.0
REJECT = 0.8
MIN_LABELS = 2
Z = 1.96
#: Tasks among which a branch's shapes are dealt in joins.
SALTS = 8
#: Stands for the end of a shape among the segments that may follow a branch.
END = "\u0000"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The index of the longest rule that fits, else null."""
    found = F.lit(None).cast("int")
    for i, r in sorted(enumerate(rules), key=lambda x: (len(x[1].name), -x[0])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    segments = F.slice(F.split(F.regexp_replace(path, "/$", ""), "/"), 2, 1 << 20)
    lexical = F.transform(segments, lambda s: F.when(s.rlike(r"^(?=[^0-9]*[0-9])[0-9A-Fa-f-]{12,}$"), F.lit("{hex}")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))
    # What begins a run keeps its name, and says whether the run goes on.
    runs = F.transform(lexical, lambda s, i: F.struct(s.alias("s"), (F.get(lexical, i - 1).eqNullSafe(s)).alias("again"), (F.get(lexical, i + 1).eqNullSafe(s)).alias("more")))
    return F.array_join(F.transform(F.filter(runs, lambda r: ~r["again"]), lambda r: F.when(r["more"], F.concat(r["s"], F.lit("+"))).otherwise(r["s"])), "/")


def form_of(rest: Column) -> Column:
    """Segments with their letters left out, but for endings behind a dot."""
    return F.when(F.size(rest) == 0, F.lit(END)).otherwise(F.regexp_replace(F.array_join(rest, "/"), r"(?<![.\p{L}])\p{L}+", "w"))


def _common(lo: Column, hi: Column) -> Column:
    """How many segments the least and the greatest of lists, and so all between them, begin with alike."""
    at = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(at > 0, at - 1).otherwise(F.size(lo)).cast("int")


def _smoothed(blocked: Column, labelled: Column, towards: Column) -> Column:
    return (blocked + ALPHA * towards) / (labelled + ALPHA)


COUNTS = ("n", "blocked", "labelled")


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows (branch, rest, ...) with ``piece``: their next segment, ``*`` where it is variable."""
    rows = rows.withColumn("head", F.coalesce(F.get("rest", F.lit(0)), F.lit(END)))
    heads = rows.groupBy("host", "branch", "head").agg(F.sum("n").alias("head_n"))
    totals = heads.groupBy("host", "branch").agg(F.count(F.lit(1)).alias("kinds"), F.sum("head_n").alias("total"))
    heads = salted_join(heads, totals, ["host", "branch"], "inner", [F.col("head")], SALTS)
    stays = (F.col("kinds") <= FEW) | (F.col("head_n") >= SHARE * F.col("total")) | (F.col("head") == END)
    heads = heads.select("host", "branch", "head", F.when(stays, F.col("head")).otherwise(F.lit("*")).alias("piece"))
    return salted_join(rows, heads, ["host", "branch", "head"], "inner", [F.col("shape")], SALTS)


def _merged(rows: DataFrame) -> DataFrame:
    """Rows (branch, rate, piece, rest, counts) to the branches of their pieces: (host, branch, piece, next, next_rate, next_pool)."""
    at = ["host", "branch"]
    kids = rows.groupBy(*at, "piece").agg(F.first("rate").alias("rate"), *[F.sum(c).alias(c) for c in COUNTS])
    # A branch has few children, whatever its urls are.
    own = kids.where("labelled > 0").withColumn("share", F.col("blocked") / F.col("labelled"))
    order = Window.partitionBy(*at).orderBy("share", "piece")
    b, l, share = (F.lag(c).over(order) for c in ("blocked", "labelled", "share"))
    pooled = (F.col("blocked") + b) / (F.col("labelled") + l)
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.0)) * (1 / F.col("labelled") + 1 / l))
    alike = F.coalesce(F.abs(F.col("share") - share) <= Z * spread, F.lit(False))
    own = own.withColumn("group", F.sum(F.when(alike, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = own.groupBy(*at, "group").agg(F.min("piece").alias("name"), F.sum("blocked").alias("g_blocked"), F.sum("labelled").alias("g_labelled"))
    named = own.join(groups, [*at, "group"]).select(*at, "piece", "name")

    forms = rows.groupBy(*at, "piece", form_of(F.col("rest")).alias("form")).agg(F.sum("n").alias("form_n"))
    known = forms.join(named, [*at, "piece"]).select(*at, "name", "form").distinct()
    unlabelled = kids.where("labelled = 0").select(*at, "piece", F.col("n").alias("kid_n"))
    # A form of a branch has as many rows as the branch has children on either side.
    seen = forms.join(unlabelled, [*at, "piece"]).join(known, [*at, "form"]).groupBy(*at, "piece", "name").agg((F.sum("form_n") / F.first("kid_n")).alias("covered")).where(F.col("covered") >= ALIKE)
    rated = groups.select(*at, "name", (F.col("g_blocked") / F.col("g_labelled")).alias("g_share"))
    best = seen.join(rated, [*at, "name"]).groupBy(*at, "piece").agg(F.min(F.struct((-F.col("covered")).alias("c"), "g_share", "name")).alias("best"))
    joined = kids.join(named.withColumnRenamed("name", "own_name"), [*at, "piece"], "left").join(best, [*at, "piece"], "left")
    joined = joined.withColumn("name", F.coalesce("own_name", F.col("best.name"), F.col("piece")))

    every = Window.partitionBy(*at)
    branch = Window.partitionBy(*at, "name")
    counts = [F.sum(c).over(branch) for c in ("blocked", "labelled")]
    # A branch that is all of its parent has the parent's purity already.
    alone = F.min("name").over(every) == F.max("name").over(every)
    rate = F.when(alone, F.col("rate")).otherwise(_smoothed(*counts, F.col("rate")))
    return joined.select(*at, "piece", F.concat("branch", F.lit("/"), "name").alias("next"), rate.alias("next_rate"), counts[1].alias("next_pool"))


def template_verdicts(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, blocked, labelled; one row a shape) to (host, shape, template, purity, rejected)."""
    overall = shapes.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    share = (overall.b or 0) / overall.l if overall.l else 0.0
    hosts = shapes.groupBy("host").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(share)).alias("rate"), F.sum("labelled").alias("pool"))
    begun = salted_join(shapes, hosts, ["host"], "inner", [F.col("shape")], SALTS)
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    rows = durable(begun.select("host", "shape", *COUNTS, F.lit("").alias("branch"), "rate", "pool", F.array().cast("array<string>").alias("done"), segments.alias("rest")))
    finished: list[DataFrame] = []
    out = lambda df, segments: df.select("host", "shape", F.array_join(segments, "/").alias("template"), F.col("rate").alias("purity"), ((F.col("pool") >= MIN_LABELS) & (F.col("rate") >= REJECT)).alias("rejected"))
    while rows.limit(1).count():
        groups = rows.groupBy("host", "branch").agg(F.count(F.lit(1)).alias("shapes"), _common(F.min("rest"), F.max("rest")).alias("common"))
        here = durable(salted_join(rows, groups, ["host", "branch"], "inner", [F.col("shape")], SALTS))
        finished.append(durable(out(here.where("shapes = 1"), F.concat("done", "rest"))))
        on = here.where("shapes > 1")
        on = on.withColumns({"done": F.concat("done", F.slice("rest", F.lit(1), F.col("common"))), "rest": F.slice("rest", F.col("common") + 1, F.size("rest"))})
        cut = durable(_pieces(on.drop("shapes", "common")))
        forget(rows, here)
        step = salted_join(cut, _merged(cut), ["host", "branch", "piece"], "inner", [F.col("shape")], SALTS)
        ended = F.col("piece") == END
        done = F.when(ended, F.col("done")).otherwise(F.concat("done", F.array("piece")))
        step = step.select("host", "shape", *COUNTS, F.col("next").alias("branch"), F.col("next_rate").alias("rate"), F.col("next_pool").alias("pool"), done.alias("done"), F.slice("rest", 2, F.size("rest")).alias("rest"), ended.alias("ended"))
        step = durable(step)
        finished.append(durable(out(step.where("ended"), F.col("done"))))
        rows = durable(step.where("NOT ended").drop("ended"))
        forget(cut, step)
    if not finished:
        return out(rows, F.col("done"))
    forget(rows)
    return reduce(DataFrame.unionAll, finished)


def judge(urls: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity), one row a url."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = urls.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("at", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    pick = lambda of: F.when(F.col("at").isNotNull(), F.element_at(of, F.col("at") + 1))
    rows = rows.withColumns({"rule": pick(names), "ruled": pick(verdicts)})
    shapes = durable(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("ruled").alias("labelled")))
    judged = salted_join(rows, template_verdicts(shapes), ["host", "shape"], "inner", [F.col("id"), F.col("path")])
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


#: Fixed values of the query's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, RULES)
