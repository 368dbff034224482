"""URL filters: stated rules by host suffix and path, and association rules mined from labelled URLs.

``token_classes`` puts tokens that stand on just the same labelled URLs into one class, so that what always comes together
(scheme, host and its suffixes, the words of one fixed path) is one item and not all subsets of many.  ``mine`` runs
Spark's FP-growth over the classes of labelled URLs, each with its label as one more item, and keeps rules that imply
``block`` with enough support and confidence and of which no shorter rule says the same.  A rule asks for one token of
each of its classes, as the rules of the single tokens would, whose figures are equal.  ``match`` finds the rules that a
URL fulfils through an inverted index: a rule stands under its rarest class alone, and where that is met the others are
checked in place.  ``judge`` lets stated rules decide first.

Null URLs, or those without ``://``, have empty host and path, fit no stated rule and have no tokens: they are allowed.
Repeated rows get equal verdicts.  Only id and url are read.  Empty tables give empty results; without labels no rule is
mined.  Of equal classes' names the smallest token is taken; a very long URL is one row whose tokens are all used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import durable

#: Stated rules: host and first path part, and the verdict.
STATED = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.6, 1.5
BLOCK = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"^(?s).*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def stated_rule(host: Column, path: Column, rules: dict[str, str] = STATED) -> Column:
    """The longest stated rule that fits, or null."""
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        domain, _, start = rule.partition("/")
        under = (host == domain) | F.endswith(host, F.lit("." + domain))
        fits = F.when(under & F.startswith(path, F.lit("/" + start)), F.lit(rule)).otherwise(fits)
    return fits


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Scheme, host suffixes, host, path words without numbers, and names of query parameters."""
    labels = F.split(host, r"\.")
    kinds = [
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([A-Za-z]+)://", 1))),
        F.array(F.concat(F.lit("host="), host), F.concat(F.lit("tld="), F.element_at(labels, -1)), F.concat(F.lit("sub="), F.element_at(labels, 1))),
        F.transform(F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike("^[0-9]+$")), lambda p: F.concat(F.lit("path="), F.regexp_replace(p, "[0-9]+", "9"))),
        F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda q: F.concat(F.lit("query="), q)),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(host != "", F.array_distinct(F.concat(*kinds))).otherwise(F.array().cast("array<string>"))


def tokenized(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    parts = pages.select(F.col("page_id").cast("long"), url.alias("url"), host.alias("host"), path.alias("path"))
    return parts.select("page_id", "host", "path", tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), F.regexp_extract("path", r"/([0-9]+)", 1).alias("number"))


def token_classes(labelled: DataFrame) -> DataFrame:
    """(t, class, n): the class of every token of the labelled URLs, and how many of these have it.

    Two tokens stand on the same URLs if they stand in the same distinct token sets, which two hashes over these say.
    """
    sets = labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n"))
    met = sets.select(F.explode("tokens").alias("t"), "n", F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"))
    marks = met.groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("sets"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    names = marks.groupBy("n", "sets", "a", "b").agg(F.min("t").alias("class"))
    return durable(marks.join(names, ["n", "sets", "a", "b"]).select("t", "class", "n"))


def in_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, classes) of distinct token sets, with the classes that any of their tokens is in."""
    met = sets.select("tokens", F.explode("tokens").alias("t")).join(classes.select("t", "class"), "t")
    return met.groupBy("tokens").agg(F.collect_set("class").alias("classes"))


def mine(labelled: DataFrame, classes: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule, classes, lead, confidence, support) from rows (tokens, bad); ``lead`` is the rarest class."""
    rows = labelled.where(F.size("tokens") > 0).withColumn("tokens", F.array_sort("tokens"))
    items = in_classes(rows.select("tokens").distinct(), classes)
    baskets = rows.join(items, "tokens").select(
        F.when(F.col("bad"), F.array_append("classes", F.lit(BLOCK))).otherwise(F.col("classes")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= lift))
    keyed = durable(rules.select(F.array_sort("antecedent").alias("classes"), "confidence", "support").withColumn("rule", F.array_join("classes", " ")))
    sizes = classes.groupBy("class").agg(F.first("n").alias("n"))
    parts = keyed.select("rule", "classes", F.explode("classes").alias("class")).join(sizes, "class")
    lead = parts.groupBy("rule").agg(F.min(F.struct("n", "class"))["class"].alias("lead"))
    led = durable(keyed.join(lead, "rule"))
    # A rule that contains a shorter rule blocks nothing more.
    short = led.select(F.col("rule").alias("short"), F.col("classes").alias("held"), F.col("lead").alias("class"))
    wider = parts.join(short, "class").where((F.size("held") < F.size("classes")) & (F.size(F.array_except("held", "classes")) == 0))
    return durable(led.join(wider.select("rule").distinct(), "rule", "left_anti"))


def match(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, hits): how many mined rules hold for each token set that has one.

    Only distinct token sets go to the index, so a host with many pages is one entry.
    """
    sets = in_classes(urls.where(F.size("tokens") > 0).select("tokens").distinct(), classes)
    index = rules.select(F.col("classes").alias("held"), "lead")
    met = sets.withColumn("lead", F.explode("classes")).join(index, "lead").where(F.size(F.array_except("held", "classes")) == 0)
    return met.groupBy("tokens").agg(F.count("*").alias("hits"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Host, path, stated rule and verdict of every page; a page is labelled through the number in its path."""
    parts = tokenized(pages)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)).alias("bad")
    )
    labelled = parts.where("number != ''").withColumn("doc_id", F.expr("try_cast(number AS bigint)")).join(marks, "doc_id")
    labelled = durable(labelled.select("tokens", (F.col("bad") == 1).alias("bad")))
    classes = token_classes(labelled)
    sets = parts.withColumn("tokens", F.array_sort("tokens"))
    index = match(sets, mine(labelled, classes), classes)
    rule = stated_rule(F.col("host"), F.col("path"))
    stated = F.create_map(*(F.lit(x) for pair in STATED.items() for x in pair))
    return sets.join(index, "tokens", "left").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule",
        F.coalesce(stated[F.col("rule")], F.when(F.col("hits") > 0, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("hits", F.lit(0).cast("long")).alias("mined_hits"),
    )
