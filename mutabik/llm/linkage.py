"""Problem 6: matching entities across sources without keys.

Collective graph linkage. Payments and sales are nodes; a candidate edge needs shared attributes:
a rare word of the written payer's name and of the seller's name (equal or one slip apart), an
amount within the allowed shortfall, and a date within reach. Edges are weighted by how rare what
they share is: name words by their inverse frequency among the sellers, scraps of a reference by
their length and their inverse frequency among the payments. They are pruned by meta-blocking (each
seller is blocked on its rarest word, a name keeps only sellers near its best), and refined: the
belief that a written name means a seller is gathered from all payments under that name and given
back to each of them, until the beliefs stay put. What is left is decided by the share of the belief
that an edge has on both its sides.

Sales and settled references are many and few of them are ever candidates, so a bit set of bounded
size (``shared.key_filter``) keeps the others out of every shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutabik.functions.scalars import is_blank, micros, norm_ref
from mutabik.shared import drop_path, kept_table, key_filter, may_join, shared_table

# Letters of written names and the plain letters they are written with.
LETTERS = ("İIıŞşĞğÜüÖöÇçÂâÎîÛûÉé", "IIISSGGUUOOCCAAIIUUEE")
#: A code that banks glue in front of a reference.
GLUED = "FT"
#: Words of statement references: one that this part of the payments has is a phrase, a tenth as frequent a scrap in full.
PHRASE = 0.01
STABLE = 0.01
#: Rounds after which beliefs move ever more slowly, so that they come to rest in any case.
FREE_ROUNDS = 5
#: Weight of the alternative that a payment pays no sale.
NONE = 5.0
#: Weight that an unclaimed phrase or a contradicted scrap takes off.
CONTRADICTED = 20.0
DAY_US = 86_400_000_000


def all_words(text: Column) -> Column:
    """Plain upper-case words of a text, in order."""
    plain = F.upper(F.translate(F.coalesce(text, F.lit("")), *LETTERS))
    return F.filter(F.split(F.regexp_replace(plain, "[^A-Z0-9]+", " "), " "), lambda w: w != "")


def words(name: Column) -> Column:
    """Distinct plain upper-case words of a written name."""
    return F.array_distinct(all_words(name))


def slips(word: Column) -> Column:
    """Hashes of the word and of the word without one of its letters: words one slip apart share one."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word))))
    each = F.concat(F.array(word), F.when(F.length(word) >= 3, cut).otherwise(F.array(word)))
    return F.array_distinct(F.transform(each, lambda x: F.xxhash64(x)))


def name_links(names: DataFrame, sellers: DataFrame) -> DataFrame:
    """name_id, ent, sim: sellers (hashed) that a written name may mean.

    names: name_id, name (distinct). sellers: entity, seller_name.
    A seller is blocked on its rarest word, a name on all of its words. Words are matched with words
    first, on ids alone, so that rows multiply only where a name and a seller share a rare word; only
    then are the words of both fetched and compared. sim is the part of the name's words, weighted by
    inverse frequency, that the seller's name explains.
    """
    s = sellers.where("entity is not null and seller_name is not null").select(F.xxhash64("entity").alias("ent"), words(F.col("seller_name")).alias("sw")).where(F.size("sw") > 0)
    n_sellers = s.count()
    n = names.select("name_id", words(F.col("name")).alias("nw")).where(F.size("nw") > 0)
    each = s.select("ent", F.explode("sw").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    known = each.join(df, "w").groupBy("ent").agg(F.min("df").alias("df"), F.collect_list(F.struct("w", "df")).alias("ws"))  # words of one name
    known = shared_table(known, "seller-words")
    rare = known.select("ent", F.explode(F.filter("ws", lambda x: x["df"] == F.col("df"))).alias("x")).select("ent", F.col("x.w").alias("sw1"))
    s_words = rare.select("sw1").distinct()
    # A word written just as one that is no seller's rarest (a trade, a legal form) isn't a slip of another.
    common = df.select(F.col("w").alias("nw1")).join(s_words.select(F.col("sw1").alias("nw1")), "nw1", "left_anti")
    n_words = n.select(F.explode("nw").alias("nw1")).distinct().join(common, "nw1", "left_anti")
    by_slip = n_words.select("nw1", F.explode(slips(F.col("nw1"))).alias("k")).join(s_words.select("sw1", F.explode(slips(F.col("sw1"))).alias("k")), "k").select("nw1", "sw1").distinct()
    alike = by_slip.where(_like(F.col("nw1"), F.col("sw1")) > 0)
    met = n.select("name_id", F.explode("nw").alias("nw1")).join(alike, "nw1").join(rare, "sw1").select("name_id", "ent").distinct()
    full = met.join(known.select("ent", "ws"), "ent").join(n, "name_id")
    idf = lambda d: F.log(F.lit(1.0 + n_sellers) / d.cast("double"))
    explained = F.transform("nw", lambda w: F.array_max(F.transform("ws", lambda v: F.struct((_like(w, v["w"]) * idf(v["df"])).alias("got"), idf(v["df"]).alias("all")))))
    # A word that the seller's name doesn't explain weighs as much as a common one.
    due = lambda x: F.when(x["got"] > 0, x["all"]).otherwise(UNEXPLAINED)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    sim = F.transform(F.array(explained), lambda xs: total(xs, lambda x: x["got"]) / total(xs, due))[0]  # within the lambda the words are compared once
    scored = full.select("name_id", "ent", sim.alias("sim"))
    best = F.max("sim").over(Window.partitionBy("name_id"))  # the few sellers that one name may mean
    return scored.withColumn("best", best).where("sim >= 0.8 * best and sim >= 0.4").select("name_id", "ent", "sim")


UNEXPLAINED = 2.0


def _like(a: Column, b: Column) -> Column:
    """1 for equal words, 0.8 one slip apart, 0.7 if the first is cut short, else 0."""
    near = (F.length(a) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) <= F.when(F.length(a) >= 4, 2).otherwise(1))
    return F.when(a == b, 1.0).when(b.startswith(a), 0.7).when(near, 0.8).otherwise(0.0)


def with_scrap(payments: DataFrame) -> DataFrame:
    """Adds scrap, the letters and digits of the written reference without its phrases, and claim, 0 to 1: how surely it is one.

    A word with a digit is a scrap. Another is one the more surely the rarer it is among the payments:
    from a part PHRASE of them (not at all) down to a tenth of that (in full), whatever their number.
    """
    w = payments.withColumn("_w", all_words(F.col("ref_text"))).withColumn("_plain", F.filter("_w", lambda x: ~x.rlike("[0-9]")))
    n = max(1, payments.count())
    often = w.select(F.explode(F.array_distinct("_plain")).alias("w")).groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") * 10.0 >= PHRASE * n)
    # So frequent are at most 10 / PHRASE times the words of a row.
    part = {r["w"]: max(0.0, min(1.0, math.log(PHRASE * n / r["df"]) / math.log(10))) for r in often.collect()}
    phrases = [x for x, c in part.items() if c == 0.0]
    kept = F.filter("_w", lambda x: ~x.isin(phrases)) if phrases else F.col("_w")
    joined = F.array_join(kept, "")
    scrap = F.when(joined.startswith(GLUED) & (F.length(joined) >= 7), F.substring(joined, 3, F.length(joined))).otherwise(joined)
    half = {x: c for x, c in part.items() if 0.0 < c < 1.0}
    sure = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in half.items() for v in p]), x), F.lit(1.0)) if half else F.lit(1.0)
    claim = F.array_max(F.transform(kept, sure))
    w = w.withColumn("scrap", F.when(F.length(scrap) >= 4, scrap).otherwise("")).withColumn("claim", F.when(F.col("scrap") != "", claim).otherwise(0.0))
    return w.drop("_w", "_plain")


def swapped(s: Column) -> Column:
    """The text with two neighbours swapped or one character left out, in every place."""
    n = F.length(s)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swaps = F.transform(at, lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.lit(1)), s.substr(i, F.lit(1)), s.substr(i + 2, n)))
    outs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, n)))
    return F.when(n >= 6, F.concat(swaps, outs)).otherwise(F.array().cast("array<string>"))


def _candidates(pay: DataFrame, links: DataFrame, sales: DataFrame, days: int, shortfall: float) -> DataFrame:
    """payment_id, sale_id, name_id, ent, held (hash of the sale's seller and reference), w: the weighted edges of the graph."""
    a_width, reach = 2 * -math.log(1 - shortfall), days * DAY_US
    a_cell = lambda c: F.floor(F.log(c.cast("double")) / a_width).cast("int")
    d_cell = lambda c: F.floor(c / F.lit(2 * reach)).cast("int")
    amount = F.col("amount")
    p = pay.join(links, "name_id")
    p = p.withColumn("ac", F.explode(F.array_distinct(F.array(a_cell(amount * (1 - 1e-9)), a_cell(amount / (1 - shortfall) * (1 + 1e-9))))))
    p = p.withColumn("dc", F.explode(F.array_distinct(F.array(d_cell(F.col("us") - reach), d_cell(F.col("us"))))))
    p, path = kept_table(p.select(F.xxhash64("ent", "ac", "dc").alias("key"), "payment_id", "name_id", "amount", "us", "scrap", "claim", "sim"), "payment-cells")
    s = sales.where("sale_id is not null and amount > 0 and at is not null and entity is not null").select(
        "sale_id", F.xxhash64("entity").alias("ent"), "ref", F.col("amount").cast("bigint").alias("due"), micros(F.col("at")).alias("sold")
    )
    s = s.withColumn("key", F.xxhash64("ent", a_cell(F.col("due")), d_cell(F.col("sold"))))
    s = may_join(s, "key", key_filter(p.select("key"), p.count())).withColumn("ref", norm_ref(F.col("ref")))
    due = F.col("due")
    enough = amount.cast("decimal(20,0)") * 1000 >= due.cast("decimal(20,0)") * int(round(1000 * (1 - shortfall)))
    inside = (F.col("us") >= F.col("sold")) & (F.col("us") - F.col("sold") <= reach) & (amount <= due) & enough
    has_scrap = F.col("scrap") != ""
    exact = amount == due
    whole = has_scrap & F.col("ref").contains(F.col("scrap"))
    end3 = F.col("ref").contains(F.substring("scrap", 1, 3)) | F.col("ref").contains(F.right("scrap", F.lit(3)))
    slip = has_scrap & ~whole & end3 & F.exists(swapped(F.col("scrap")), lambda v: F.col("ref").contains(v))
    level = F.when(whole, 3).when(slip, 2).when(exact, 1).otherwise(0)
    fits = p.join(s, "key").where(inside).withColumn("how", F.explode(F.array(level))).where("how > 0")  # generated, so it is computed once
    claim, how = F.col("claim"), F.col("how")
    shared = F.when(how == 3, claim * 1.2 * F.length("scrap")).when(how == 2, claim * (0.9 * F.length("scrap") - 1.0)).otherwise(4.0 - CONTRADICTED * claim)
    w = 4.0 * F.col("sim") + shared + F.when(exact, 2.0).otherwise(0.0) - 0.1 * (F.col("us") - F.col("sold")) / DAY_US
    edges = fits.select("payment_id", "sale_id", "name_id", "ent", F.xxhash64("ent", "ref").alias("held"), w.alias("w"))
    # An edge below what 'no sale' weighs by this much can't win, nor sway one that does.
    edges = edges.where(F.col("w") > NONE - 7.0).groupBy("payment_id", "sale_id", "name_id", "ent", "held").agg(F.max("w").alias("w"))
    out = shared_table(edges, "edges")
    drop_path(pay.sparkSession, path)
    return out


def link(payments: DataFrame, sales: DataFrame, sellers: DataFrame, settled: DataFrame, days: int = 5, shortfall: float = 0.03) -> DataFrame:
    """payment_id, sale_id, confidence: the sale that each payment pays, where one is held for true.

    payments: payment_id, name, ref_text, amount, at. sales: sale_id, entity, ref, amount, at.
    sellers: entity, seller_name. settled: entity, ref of sales that other lines already pay.
    A payment comes 0 to ``days`` days after its sale, with its amount or up to ``shortfall`` less;
    it pays at most one sale, and a sale is paid by at most one payment.

    Defined results: payments or sales with a null id, amount or time match nothing; a blank name
    matches nothing; repeated rows count once; if two sales fit a payment equally well none is
    returned; empty tables give an empty result. Entities are compared by 64-bit hashes.
    """
    pay = payments.where("payment_id is not null and amount > 0 and at is not null").where(~is_blank(F.col("name")))
    pay = pay.select("payment_id", "name", "ref_text", F.col("amount").cast("bigint").alias("amount"), micros(F.col("at")).alias("us"))
    pay = shared_table(pay.dropDuplicates(["payment_id"]).withColumn("name_id", F.xxhash64("name")), "payments")
    links = shared_table(name_links(pay.groupBy("name_id").agg(F.min("name").alias("name")), sellers), "name-links")
    cand = _candidates(with_scrap(pay), links, sales, days, shortfall)
    held = settled.where("entity is not null").where(~is_blank(F.col("ref"))).select(F.xxhash64(F.xxhash64("entity"), norm_ref(F.col("ref"))).alias("held"))
    paid = may_join(held, "held", key_filter(cand.select(F.col("held").alias("key")), cand.count())).distinct().withColumn("paid", F.lit(True))
    edges = cand.join(paid, "held", "left").select("payment_id", "sale_id", "name_id", "ent", (F.col("w") - F.when(F.col("paid"), CONTRADICTED).otherwise(0.0)).alias("w"))
    edges = shared_table(edges.repartition("payment_id"), "weighted-edges")
    return _decide(_refine(edges))


def _shares(edges: DataFrame, belief: DataFrame | None) -> DataFrame:
    """p: an edge's part of the belief at the payment, q: at the sale; a standing alternative is 'none'."""
    e = edges
    if belief is not None:
        e = e.join(belief, ["name_id", "ent"], "left").withColumn("w", F.col("w") + 1.5 * F.log(F.coalesce("link", F.lit(0.0)) + 0.05)).drop("link")
    e = e.withColumn("x", F.exp(F.least(F.col("w"), F.lit(40.0))))
    by_s = e.groupBy("sale_id").agg(F.sum("x").alias("xs"))
    none = math.exp(NONE)
    xp = F.sum("x").over(Window.partitionBy("payment_id"))  # the few sales that one payment may pay
    return e.join(by_s, "sale_id").withColumn("p", F.col("x") / (xp + none)).withColumn("q", F.col("x") / (F.col("xs") + none))


def _refine(edges: DataFrame) -> DataFrame:
    """Rounds of gathering, for each written name, which sellers its payments point to, until no belief moves by STABLE.

    After FREE_ROUNDS a belief moves only by a falling part of the way, so the rounds end.
    """
    spark = edges.sparkSession
    belief, path, done = None, None, 0
    while True:
        done += 1
        e = _shares(edges, belief)
        support = e.groupBy("name_id", "ent").agg(F.sum(F.col("p") * F.col("q")).alias("s"))
        total = support.groupBy("name_id").agg(F.sum("s").alias("all"))
        now = support.join(total, "name_id").select("name_id", "ent", (F.col("s") / (F.col("all") + 0.25)).alias("link"))
        if belief is not None:
            step = 1.0 / max(1, done - FREE_ROUNDS)
            was = F.coalesce("was", F.lit(0.0))
            now = now.join(belief.withColumnRenamed("link", "was"), ["name_id", "ent"], "left").withColumn("link", was + step * (F.col("link") - was)).withColumn("moved", F.abs(F.col("link") - was)).drop("was")
        now, new_path = kept_table(now, "beliefs")
        settled = belief is not None and not (now.agg(F.max("moved")).first()[0] or 0.0) >= STABLE
        belief = now.select("name_id", "ent", "link")
        if path:
            drop_path(spark, path)
        path = new_path
        if settled:
            return _shares(edges, belief)


def _decide(e: DataFrame) -> DataFrame:
    """Edges that are the best on both their sides and hold more than half of the belief there."""
    conf = e.withColumn("confidence", F.least("p", "q"))
    return conf.where("p > 0.5 and q > 0.5").select("payment_id", "sale_id", "confidence")
