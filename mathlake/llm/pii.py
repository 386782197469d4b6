"""Personal data by base patterns and bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find emails, addresses of machines, cards and phones; tokens of 32 hexadecimal digits and more, letters among
them, are seeds of a fifth kind, secrets. A seed's patterns are the last word before it, the last two, the last one with the
seed's shape (runs of digits and of letters told apart, whatever their length), and the word after it; quotes and brackets
are left out, and white space is one space. Every other token with a digit, groups of digits joined, is a candidate with
patterns of its own.
Patterns and instances form a graph that is scored in rounds: a pattern's confidence is the share of its distinct
instances that are known, an instance's confidence one less the product of its patterns' doubts; confident instances
become known and feed the next round, until none is added. The patterns that are confident then mark candidates that no base pattern
sees, the seeds of secrets among them: a long number without such a pattern before it is left alone. Base spans always stay.

The graph is pre-aggregated to distinct (pattern, instance) pairs before each shuffle and holds a hash of each instance, so a
frequent word before many identifiers is one counted group, never a list. Regular expressions use possessive repeats,
which neither back-track nor recurse over long runs.

Defined cases: null text has no spans; spans of different kinds may overlap; positions are code points, ends exclusive;
a word counts by the WORD characters next to the match;
repeated rows and null doc_ids are rows of their own; an empty table gives no rows; `mask` keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import discard, materialise

KINDS = ["email", "ip", "card", "phone"]
ALL = [*KINDS, "secret"]
#: The base patterns, as possessive equivalents that start only where a run starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern's extraction to be worth while.
GUARDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![A-Za-z0-9])(?:[A-Za-z]++[-_.:/])*+[A-Za-z]*+[0-9](?:[-_./+:=]?[A-Za-z0-9]|\x20[0-9])*+"
SECRET = r"\A(?=[0-9a-fA-F]*+\z)(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F]).{32,}\z"
#: Known instances that a pattern needs at least, and the confidence from which patterns and instances are sure.
SUPPORT, SURE = 5, 0.9
#: Characters of a word that count, characters kept before a match (two such words and more), matches of a text folded at once.
WORD, CONTEXT, BLOCK = 100, 256, 1000
QUOTES = r"\"'`(\[{<"
AFTER = r"\A[\s\"'`)\]}>.,;:!?]*+([^\s\"'`)\]}>.,;:!?]++)"
#: Confident patterns that are written into the plan at most; more are joined.
LITERALS = 256
SPAN = "array<struct<start:int,end:int,found:long,secret:boolean,patterns:array<string>>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = digits(m)

    def add(total: Column, i: Column) -> Column:
        one = F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(one * 2 > 9, one * 2 - 9).otherwise(one * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(one)

    fits = F.length(d).between(13, 19)
    return F.when(fits, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(False)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda x: F.when(F.length(part(x)) <= 3, part(x).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def squeezed(s: Column) -> Column:
    return F.regexp_replace(s, r"\s++", " ")


def shape(m: Column) -> Column:
    """A match with each run of digits alone as 9, each other run of letters and digits as x."""
    return F.regexp_replace(F.regexp_replace(F.lower(m), "[0-9]*+[a-z][a-z0-9]*+", "x"), "[0-9]++", "9")


def patterns_of(before: Column, m: Column, after: Column) -> Column:
    """The last word before, the last two, the last with the match's shape, the first after. Tabs, which no word has, tell
    the kinds of patterns apart.
    """
    bare = F.rtrim(F.regexp_replace(F.lower(before), rf"[\s{QUOTES}]+\z", ""))
    words = F.transform(F.split(F.trim(bare), " "), lambda w: F.right(w, F.lit(WORD)))
    next_ = F.lower(F.left(F.regexp_extract(after, AFTER, 1), F.lit(WORD)))

    def all_(w: Column) -> Column:
        last = F.element_at(w, -1)
        two = F.array_join(F.slice(F.concat(F.array(F.lit("")), w), -2, 2), " ")
        shaped = F.when(last != "", F.concat(last, F.lit("\t"), F.xxhash64(shape(m)).cast("string")))
        follows = let(next_, lambda n: F.when(n != "", F.concat(F.lit("\t"), n)))
        return F.array_distinct(F.filter(F.array(F.trim(two), last, shaped, follows), lambda p: p != ""))

    return let(words, all_)


def located(text: Column, pattern: str, ok, guard: Column, secret=None) -> Column:
    """All matches that hold: start, end, a hash of the match, whether it is a secret's seed, and its patterns.

    The pieces between the matches give the positions; only valid matches are added to the result. A text's matches are
    folded in blocks, so that the list that grows in a fold stays short.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = let(gaps, lambda g: F.arrays_zip(found.alias("m"), F.slice(g, F.lit(1), F.size(found)).alias("g"), F.slice(g, F.lit(2), F.size(found)).alias("a")))
    nothing = F.array().cast(SPAN)

    def step(s: Column, x: Column) -> Column:
        def put(before: Column) -> Column:
            start = s["pos"] + F.length(x["g"])
            end = start + F.length(x["m"])
            of = (secret or (lambda m: F.lit(False)))(x["m"])
            one = F.struct(start.alias("start"), end.alias("end"), F.xxhash64(x["m"]).alias("found"), of.alias("secret"), patterns_of(before, x["m"], x["a"]).alias("patterns"))
            tail = F.right(squeezed(F.concat(before, x["m"])), F.lit(CONTEXT))
            return F.struct(end.alias("pos"), tail.alias("tail"), F.when(ok(x["m"]), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

        return let(F.right(squeezed(F.concat(s["tail"], x["g"])), F.lit(CONTEXT)), put)

    def blocks(p: Column) -> Column:
        def fold(b: Column) -> Column:
            earlier = F.transform(F.slice(p, b * BLOCK - (CONTEXT - 1), F.lit(CONTEXT)), lambda x: F.concat(x["g"], x["m"]))
            tail = F.when(b > 0, F.right(squeezed(F.array_join(earlier, "")), F.lit(CONTEXT))).otherwise("")
            begin = F.struct(F.lit(0).alias("pos"), tail.alias("tail"), nothing.alias("out"))
            return F.aggregate(F.slice(p, b * BLOCK + 1, F.lit(BLOCK)), begin, step, lambda s: F.struct(s["pos"].alias("size"), s["out"].alias("out")))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), fold)

    def shift(s: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda o: F.struct((o["start"] + s["pos"]).alias("start"), (o["end"] + s["pos"]).alias("end"), o["found"].alias("found"), o["secret"].alias("secret"), o["patterns"].alias("patterns")))
        return F.struct((s["pos"] + x["size"]).alias("pos"), F.concat(s["out"], F.array(moved)).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
    all_ = let(pieces, lambda p: F.when(F.size(p) > 0, F.aggregate(blocks(p), begin, shift, lambda s: F.flatten(s["out"]))).otherwise(nothing))
    return F.when(guard, all_).otherwise(nothing)


def base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, the base spans of each kind, and the other tokens with digits as candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"))
    t = F.col("__text")
    for kind in KINDS:
        rows = rows.withColumn(f"__{kind}", located(t, PATTERNS[kind], lambda m, k=kind: valid(k, m), t.rlike(GUARDS[kind])))
    tokens = located(t, CANDIDATE, lambda m: F.lit(True), t.rlike("[0-9]"), lambda m: m.rlike(SECRET))
    taken = F.concat(*(F.col(f"__{k}") for k in KINDS))
    free = let(taken, lambda k: F.filter(tokens, lambda c: ~F.exists(k, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))))
    return rows.withColumn("__free", free).drop("__text")


def graph(rows: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) pairs with the kind of seeds; candidates have none."""
    seed = F.when(F.col("s.secret"), "secret")
    parts = [rows.select(F.explode(c).alias("s")).select(k.cast("string").alias("kind"), F.col("s.found").alias("instance"), F.explode("s.patterns").alias("pattern")) for k, c in [*((F.lit(k), f"__{k}") for k in KINDS), (seed, "__free")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def score_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """pattern, kind, confidence and support of every pattern: known instances of its best kind over all instances; and
    whether it has a candidate that it could mark.

    An instance counts under one kind at most, its seed kind or the one it was promoted to.
    """
    label = edges.join(known, "instance", "left")
    counts = label.groupBy("pattern").agg(F.count("*").alias("n"), F.bool_or("free").alias("marks"), *(F.count_if(F.col("known") == k).alias(k) for k in ALL))
    best = F.greatest(*ALL)
    kind = F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in ALL))
    return counts.select("pattern", kind.alias("kind"), (best / F.col("n")).alias("confidence"), best.alias("support"), "marks")


def learn(rows: DataFrame, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """The patterns (pattern, kind) that are confident once no round adds an instance, and that mark candidates. Each round
    but the last adds an instance at least.
    """
    edges = materialise(graph(rows), "pii-graph")
    pairs = edges.groupBy("pattern", "instance").agg(F.bool_or(F.col("kind").isNull() | (F.col("kind") == "secret")).alias("free"))
    known = materialise(edges.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("known")), "pii-known")
    while True:
        strong = materialise(score_patterns(pairs, known).filter((F.col("support") >= support) & (F.col("confidence") >= sure)), "pii-patterns")
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        fresh = pairs.join(strong, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score"), F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("known"))
        promoted = materialise(fresh.filter(F.col("score") >= sure).select("instance", "known").join(known.select("instance"), "instance", "left_anti"), "pii-promoted")
        if promoted.isEmpty():
            discard(edges, known, promoted)
            return strong.filter("marks").select("pattern", "kind")
        more = materialise(known.unionByName(promoted), "pii-known")
        discard(known, strong, promoted)
        known = more


def spans(docs: DataFrame, keep: list[str] | None = None, literals: int = LITERALS) -> DataFrame:
    """The kept columns of every row with __base (its base spans) and __spans (all): arrays of (rank, start, end), rank by ALL.

    A candidate that several kinds' patterns mark is a span of the first kind. Few confident patterns are written into
    the plan, and no row is shuffled; many are joined.
    """
    keep = keep or ["doc_id"]
    rows = materialise(base(docs, keep).withColumn("__row", F.monotonically_increasing_id()), "pii-base")
    confident = learn(rows).withColumn("rank", F.array_position(F.array(*map(F.lit, ALL)), F.col("kind")).cast("int"))
    bare = lambda k: F.transform(F.col(f"__{KINDS[k]}"), lambda s: F.struct(F.lit(k + 1).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    seeds = F.concat(*(bare(k) for k in range(len(KINDS))))
    out = rows.withColumn("__base", F.array_sort(seeds))
    if len(few := confident.select("pattern", "rank").take(literals + 1)) <= literals:
        known = F.array(*(F.struct(F.lit(r["pattern"]).alias("pattern"), F.lit(r["rank"]).alias("rank")) for r in few)) if few else F.array().cast("array<struct<pattern:string,rank:int>>")
        rank = lambda c: F.array_min(F.transform(F.filter(known, lambda q: F.array_contains(c["patterns"], q["pattern"])), lambda q: q["rank"]))
        ranked = F.transform("__free", lambda c: F.struct(rank(c).alias("rank"), c["start"].alias("start"), c["end"].alias("end")))
        more = F.filter(ranked, lambda c: c["rank"].isNotNull())
    else:
        free = rows.select("__row", F.explode("__free").alias("s")).select("__row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
        best = free.join(confident, "pattern").groupBy("__row", "start", "end").agg(F.min("rank").alias("rank"))
        out = out.join(best.groupBy("__row").agg(F.collect_list(F.struct("rank", "start", "end")).alias("__more")), "__row", "left")
        more = F.coalesce("__more", F.array().cast("array<struct<rank:int,start:int,end:int>>"))
    return out.withColumn("__spans", F.array_sort(F.concat("__base", more))).select(*keep, "__base", "__spans")


def written(column: str) -> Column:
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, literals: int = LITERALS) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, all spans as text, and their number n_spans."""
    found = spans(docs, literals=literals)
    number = lambda rank: F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("long")
    counts = [number(k + 1).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("__base").cast("binary"), 256).alias("base_sha256"), written("__spans").alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    # The other columns travel as one, so their names cannot clash with those used here.
    rest = [c for c in docs.columns if c != "text"]
    found = spans(docs.select("text", F.struct(F.lit(0).alias("none"), *rest).alias("rest")), ["text", "rest"])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))

    def step(s: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), s["pos"] + 1, x["start"] - s["pos"])
        inside = x["start"] < s["pos"]
        return F.struct(F.greatest(s["pos"], x["end"]).alias("pos"), F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(before, F.element_at(names, x["rank"])))).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    tail = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["pos"] + 1, F.length("text")))
    masked = F.when(F.size("__spans") > 0, F.aggregate(ordered, begin, step, tail)).otherwise(F.col("text"))
    return found.select(*(masked.alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
