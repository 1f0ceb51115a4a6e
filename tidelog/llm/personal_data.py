"""Personal data: base patterns with code point spans, and bootstrapped contextual extraction of unseen identifiers.

Base entities are leftmost, non-overlapping matches of one pattern a kind (`KINDS`); a match that fails its test
(parts of an address, digits of a number, Luhn) is dropped without another try. The patterns below accept the same
strings as the stated ones; look-behinds and possessive repeats keep the search linear in long runs.

Bootstrapping. The word before an entity is a lexical pattern, an identifier-like token (four digits or an inner @)
after such a word an instance. Base entities are seeds with score 1. In each of ROUNDS turns a pattern scores the sum
of its instances' scores by all occurrences of its word in the corpus, and an instance 1 - prod(1 - pattern score).
A pattern with SUPPORT distinct seeds and a score of CONFIDENCE or more is taken, and the unseen tokens it extracts
become spans of its seeds' most frequent kind. Base spans stay as they are.

Everything is built-in DataFrame expressions. What leaves the scan is small: spans, contexts and identifier-like
tokens. Word occurrences are counted only for words that are patterns, combined before the shuffle; patterns, and the
texts that gain spans, are broadcast only up to BROADCAST rows (counted) and else joined by a shuffle.

Defined results: null texts are empty; an empty text has no spans. Repeated rows give repeated results: all depend on
the text alone. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch, spark_of

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold for a valid match: cheaper to look for than the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+", "token": "[0-9@]"}
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
ROUNDS, SUPPORT, CONFIDENCE, BROADCAST = 3, 3, 0.5, 100_000


def _gaps(text: Column, pattern: str, hint: str) -> Column:
    """The text cut by `pattern`: structs (gap, before, hit) of each match, the code points ahead of it, up to 64 of them, and itself; null without the hint."""
    cut = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(64)).alias("before"), h.alias("hit")))
    hinted = F.contains(text, F.lit(hint)) if len(hint) == 1 else F.regexp_like(text, F.lit(hint))
    return F.when(hinted, F.filter(cut, lambda x: x["hit"].isNotNull()))


def _located(gaps: Column) -> Column:
    """Structs (start, end, hit, before) of `_gaps`. The running place is kept as a string, which grows without copying structs."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["out"], start.cast("string"), F.lit(",")).alias("out"))

    starts = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.split(acc["out"], ","))

    def place(x: Column, s: Column) -> Column:
        start = s.try_cast("int")
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))

    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string>>")
    return F.coalesce(F.filter(F.zip_with(gaps, starts, place), lambda m: m["hit"].isNotNull()), none)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _base() -> Column:
    """Base entities as structs (start, kind number, end, hit, before), by start and kind."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(_located(F.col(f"gaps_{kind}")), lambda m: _valid(kind, m["hit"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["hit"].alias("hit"), m["before"].alias("before")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _word_before(before: Column) -> Column:
    """The lower-cased word that ends `before`, white space aside; empty if there is none."""
    return F.lower(F.regexp_extract(before, r"([^\s]+)\s+$", 1))


def _tokens() -> Column:
    """Identifier-like tokens without the punctuation around them, as structs (start, end, token, word before)."""

    def trimmed(m: Column) -> Column:
        start = m["start"] + F.length(F.regexp_extract(m["hit"], r"^[^\p{L}\p{N}+]*", 0))
        token = F.regexp_replace(m["hit"], r"^[^\p{L}\p{N}+]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        return F.struct(start.alias("start"), (start + F.length(token)).alias("end"), token.alias("token"), _word_before(m["before"]).alias("word"))

    like = lambda t: (F.length(t["token"]) >= 6) & (t["word"] != "") & t["token"].rlike(r"[\p{L}\p{N}]@[\p{L}\p{N}]|(?:[0-9][^0-9]*+){4}")
    return F.filter(F.transform(_located(F.col("gaps_token")), trimmed), like)


def _spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def patterns(found: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, kind, score, seeds) of the patterns taken, from `found` (base, tokens) and `texts` (text)."""
    seed = found.select(F.explode("base").alias("s")).select(_word_before(F.col("s.before")).alias("word"), F.col("s.kind").alias("kind"), F.lower("s.hit").alias("item")).where("word <> ''")
    seeds = scratch.keep(seed.groupBy("word", "kind", "item").agg(F.count("*").alias("n")), "seeds")
    words = seeds.groupBy("word").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    words = scratch.keep(words, "words")
    if not words.head(1):
        return words.select("word", F.lit(0).alias("kind"), F.lit(0.0).alias("score"), "seeds")
    listed = _small(words.select("word"))
    count = texts.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).join(listed, "word", "left_semi").groupBy("word").agg(F.count("*").alias("all"))
    count = scratch.keep(count, "counts")
    token = found.select(F.explode("tokens").alias("t")).select(F.col("t.word").alias("word"), F.lower("t.token").alias("item"))
    token = token.join(listed, "word", "left_semi").groupBy("word", "item").agg(F.count("*").alias("n")).withColumn("seed", F.lit(0.0))
    edges = seeds.groupBy("word", "item").agg(F.sum("n").alias("n")).join(listed, "word", "left_semi").withColumn("seed", F.lit(1.0))
    edges = scratch.keep(edges.unionByName(token), "edges")
    rated = edges.select("word", "item", "n", "seed", F.col("seed").alias("score"))
    for turn in range(ROUNDS):
        scores = rated.groupBy("word").agg(F.sum(F.col("score") * F.col("n")).alias("s")).join(count, "word").select("word", F.least(F.lit(1.0), F.col("s") / F.col("all")).alias("p"))
        scores = scratch.keep(scores, f"scores-{turn}")
        again = edges.join(scores, "word").groupBy("item").agg(F.max("seed").alias("known"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("q"))
        rated = edges.join(again, "item").select("word", "item", "n", "seed", F.greatest("known", "q").alias("score"))
    best = seeds.groupBy("word", "kind").agg(F.sum("n").alias("n")).groupBy("word").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
    return scores.where(F.col("p") >= CONFIDENCE).join(words, "word").join(best, "word").select("word", "kind", F.col("p").alias("score"), "seeds")


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for every row of `docs` (doc_id, text): arrays of structs (start, kind, end), kind a place in KINDS."""
    scratch = Scratch(spark_of(docs), "personal")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = [_gaps(F.col("text"), p, HINTS[k]).alias(f"gaps_{k}") for k, p in {**KINDS, "token": TOKEN}.items()]
    found = texts.select("doc_id", F.md5("text").alias("digest"), *cut).select("doc_id", "digest", _base().alias("base"), _tokens().alias("tokens"))
    found = scratch.keep(found, "found")
    taken = _small(scratch.keep(patterns(found, texts, scratch), "patterns"))
    unseen = found.where("size(tokens) > 0").dropDuplicates(["digest"]).select("digest", "base", F.explode("tokens").alias("t"))
    unseen = unseen.where(~F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"])))
    unseen = unseen.join(taken, F.col("t.word") == taken["word"]).groupBy("digest").agg(F.collect_set(F.struct(F.col("t.start").alias("start"), F.col("kind"), F.col("t.end").alias("end"))).alias("added"))
    unseen = _small(scratch.keep(unseen, "unseen"))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.join(unseen, "digest", "left").select("doc_id", plain.alias("base"), F.coalesce("added", none).alias("added"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row of `docs`; n_spans counts all spans."""
    found = found_in(docs)
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), _spans(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
