"""URL filters: host rules first, then rules mined from labels.

A url gives tokens: the labels of its host, its path segments and the names of its query's parameters. FP-growth finds combinations of tokens that
labelled urls share with the label *unwanted*; combinations, however long, that reach the support and the confidence become rules. Rules are kept
in an inverted index under tokens of one item; a url looks up its tokens there and a rule fits if the url has all of its items. The best one has the highest confidence,
then support. No url is shuffled: the index goes to the rows.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens and the verdict allow. Rows that repeat a page are judged
each by itself. Labels that are null, or contradict each other for an id, don't count. Without labelled urls there are no mined rules. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT = 0.002
CONFIDENCE = 0.75
#: Mined rules that are sent to every executor at once.
SENT = 100_000
_UNWANTED = "!"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to /, ?, # or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: ``h:`` labels of the host, ``p:`` segments of the path, ``q:`` names in the query. Numbers are one token."""

    def parts(text: Column, at: str, kind: str) -> Column:
        words = F.filter(F.split(F.lower(text), at), lambda x: x != "")
        return F.transform(words, lambda x: F.concat(F.lit(kind), F.regexp_replace(x, r"[0-9]+", "0")))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    return F.array_distinct(F.concat(parts(host_of(url), r"[.\-:@]", "h:"), parts(path_of(url), r"[/.\-_]", "p:"), parts(F.regexp_replace(query, r"=[^&]*", ""), "&", "q:")))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(out)
    return out


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """items, confidence, support of mined rules, from rows (tokens, unwanted boolean). An item is an array of tokens of which a url needs one; a rule needs all its items.

    Itemsets grow with two to the power of tokens that come together, so what can't change a verdict goes first: tokens that are rules by
    themselves (every longer rule with them fits fewer urls), tokens too rare among unwanted urls for any rule, and all but one of the tokens that the very same urls
    have (a rule with one of them is a rule with any other).
    """
    baskets = common.cut(urls.where(F.size("tokens") > 0).select("tokens", F.coalesce("unwanted", F.lit(False)).alias("unwanted"), F.monotonically_increasing_id().alias("basket")))
    total = max(1, baskets.count())
    token = baskets.select(F.explode("tokens").alias("token"), "unwanted", F.xxhash64("basket").alias("h"), F.xxhash64("basket", F.lit(1)).alias("h2"))
    token = token.groupBy("token").agg(F.count("*").alias("n"), F.count_if("unwanted").alias("bad"), F.bit_xor("h").alias("h"), F.bit_xor("h2").alias("h2"))
    token = common.cut(token.where(F.col("bad") >= support * total).withColumn("sure", F.col("bad") >= confidence * F.col("n")))
    single = token.where("sure").select(F.array(F.array("token")).alias("items"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(total)).alias("support"))
    # Tokens of the same urls are one item, named by the first of them. There are at most as many of these tokens as their support allows in a basket's length.
    alike = token.where("not sure").groupBy("n", "bad", "h", "h2").agg(F.array_sort(F.collect_list("token")).alias("alike")).select(F.col("alike")[0].alias("item"), "alike")
    items = baskets.select("basket", "unwanted", F.explode("tokens").alias("item")).join(alike, "item")
    items = items.groupBy("basket", "unwanted").agg(F.collect_set("item").alias("own"))
    items = items.select(F.when(F.col("unwanted"), F.array_append("own", F.lit(_UNWANTED))).otherwise(F.col("own")).alias("items"))
    items = common.cut(items)
    kept = items.count()
    if not kept:
        return single
    # Baskets that lost all their tokens still count in the support.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * total / kept), minConfidence=confidence, numPartitions=common.partitions(urls.sparkSession)).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _UNWANTED)).withColumn("rule", F.monotonically_increasing_id())
    rules = common.cut(rules.select("rule", "antecedent", "confidence", (F.col("support") * kept / total).alias("support")))
    parts = rules.select("rule", "confidence", "support", F.explode("antecedent").alias("item")).join(alike, "item")
    longer = parts.groupBy("rule").agg(F.array_sort(F.collect_list("alike")).alias("items"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return single.union(longer.select("items", "confidence", "support"))


class Index:
    """Rules by a token: each rule stands under the tokens of one of its items, the one with fewest rules under it so far."""

    def __init__(self, rules: list[tuple[list[list[str]], float, float]]):
        self.under: dict[str, list[int]] = {}
        self.rules = []
        for items, confidence, support in sorted(rules, key=lambda r: (-r[1], -r[2], r[0])):  # best first
            sets = [frozenset(x) for x in items]
            anchor = min(sets, key=lambda x: max(len(self.under.get(t, ())) for t in x))
            for t in anchor:
                self.under.setdefault(t, []).append(len(self.rules))
            self.rules.append((sets, " ".join("|".join(x) for x in items), confidence))

    def best(self, tokens) -> tuple[str | None, float | None]:
        """The best rule that fits."""
        own = set(tokens)
        found = len(self.rules)
        for t in own:
            for k in self.under.get(t, ()):
                if k >= found:
                    break
                if all(not x.isdisjoint(own) for x in self.rules[k][0]):
                    found = k
                    break
        return self.rules[found][1:] if found < len(self.rules) else (None, None)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (tokens, ...) with mined_rule and confidence of the best rule that fits, each row looked up where it is.

    The index is sent while there are at most SENT rules; more of them are sent in portions of that size, one after another.
    """
    rules = common.cut(rules.withColumn("portion", F.lit(0)))
    portions = max(1, -(-rules.count() // SENT))
    rules = rules.withColumn("portion", F.pmod(F.xxhash64("items"), F.lit(portions)))
    out = urls.withColumns({"mined_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    for k in range(portions):
        index = Index([(r["items"], r["confidence"], r["support"]) for r in rules.where(F.col("portion") == k).collect()])
        sent = urls.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = {name: n for n, name in enumerate(b.schema.names)}
                found = [sent.value.best(t or ()) for t in b.column(at["tokens"]).to_pylist()]
                old = zip(b.column(at["mined_rule"]).to_pylist(), b.column(at["confidence"]).to_pylist())
                found = [max(x, y, key=lambda v: -1.0 if v[1] is None else v[1]) for x, y in zip(old, found)]
                columns = [b.column(c) for c in b.schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], b.schema.names)

        out = out.mapInArrow(look, out.schema)
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for every row. labelled: rows (id, unwanted boolean)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    known = labelled.where("id is not null and unwanted is not null").groupBy("id").agg(F.bool_or("unwanted").alias("unwanted"), F.bool_and("unwanted").alias("sure")).where("unwanted = sure")
    baskets = common.cut(rows.join(known, F.col("page_id") == F.col("id")).select(tokens_of(F.col("url")).alias("tokens"), "unwanted"))
    out = matches(rows.withColumn("tokens", tokens_of(F.col("url"))), mine(baskets, support, confidence))
    out = out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "confidence")
