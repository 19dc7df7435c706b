"""Secret scan: rule spans, and spans that two character Markov models tell apart.

Everything on the main path is a DataFrame or SQL function. Rules give base spans. Other long tokens are scored by
the log-likelihood ratio of two first-order character models, one of random strings and one of ordinary
tokens, trained from labelled samples; tokens at or above a threshold that touch no base span are added. Ordinary
samples are the kinds of long clean tokens (paths, slugs, dates, numbers, camel case, constants, ruled lines), made
of the documents' own words, and the documents' shorter tokens that no rule catches; long uncaught tokens are what is
judged and may be secrets, so they teach nothing. The threshold is chosen on samples of documents held out from both.

Defined results: a null or empty text has no spans. Repeated rows give equal rows. Very long texts are scanned
whole. With no samples of a label its model is uniform. Other columns are left alone.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import own_columns

# fixed values: the rules (kind, pattern, group whose length counts, least length), in the order of kinds
RULES = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]  # the run of hex digits is greedy, so asking for 32 in the pattern drops the same matches as checking afterwards
ADDED = "markov"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIDE = len(ALPHABET) + 1
SMOOTHING = 0.5
SAMPLE_DOCS = 4000
# fixed words of identifiers, paths and settings: every other word group is dealt from them
IDENTIFIERS = (
    "abstract access account action active adapter address admin after alert algorithm allow analysis apply archive argument array article assert async attribute author auto average background balance base batch before binary block board boolean bridge broker browser buffer build bundle button cache calculate callback category change channel character check class client close cluster code collection column command comment commit common complete component config connect constant container content context control convert cookie copy count create credit currency current custom daily data date debug default delete delivery depth derived detail device dialog digest direct disable display document domain download driver dynamic edge editor effect element empty enable encode engine entity entry equity error event example exception exchange exclude execute exist expand explicit export express external extract factory failure false feature field file filter final find first fixed flag flow folder following format forward found framework free frequency function gateway general generate global graph group guide handle handler hash header height hidden history home host hybrid icon identifier image implement import improper include index initial inject input insert install instance integer interface internal invalid item iterator join journal json judge junction jump keep kernel keyboard label language large latest layer layout length level library license light limit linear link list listener load local location lock logger login lookup loop machine main manager manifest mapping market matrix maximum member memory message method metric middle migrate minimum mixin mobile mode model module monitor multiple mutex name native navigate nested network next node notify null number object observer offset open operator optimize option order origin output owner package page panel parameter parent parse partial password path pattern payload pending percent performance permission pipeline pixel plain platform plugin point policy pool port position prefetch prefix price primary print priority private process product profile project property protocol provider proxy public publish purge push python quality quantity query queue quick quote random range rank ratio read realm receive record recursive redirect reduce reference refresh region registry release remote render replace report repository request reset resource response result retry return review rollback root route router rule runtime sample scale schedule schema scope score script search secret section security select sequence serial server service session setting share shell shift signal simple single singleton size skip slice snapshot socket sort source special split stack stage standard start state static status step storage store strategy stream strict string strong style subject submit success suffix summary support switch symbol sync syntax system table target task template temporary tenant test text theme thread threshold ticket time title toggle token tool total trace track transaction transfer transform trigger true type unique unit unknown update upgrade upload usage user util valid value variable vector vendor verbose verify version view virtual visible volume wait warning watch weak web weight widget width window worker workflow wrapper write yield zero zone"
).split()
HELD_OUT = 0.25  # share of the sample's documents
GROUPS = 8  # word groups of a document that samples are made of
LEAST_RATIO = 0.5  # mean log-likelihood ratio of a character, in nats; used where a kind has no held-out samples
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


PART = 128


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_carry(items: Column, measure, total) -> Column:
    """Parts of `PART` items, each with what the measures of all parts before it come to: array of (part, carry).

    Appending inside a part only, work grows with the items times `PART`, not with their square."""

    def cut(all_items: Column) -> Column:
        number = F.ceil(F.size(all_items) / F.lit(float(PART))).cast("int")
        starts = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda b: F.slice(all_items, b * PART + 1, PART))

    def carried(parts: Column) -> Column:
        sums = F.transform(parts, measure)
        return _let(sums, lambda m: F.transform(parts, lambda part, b: F.struct(part.alias("part"), total(F.slice(m, F.lit(1), b)).alias("carry"))))

    return _let(_let(items, cut), carried)


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, keep: Column | None = None) -> Column:
    """All matches as spans in code points: the pieces between matches and the matches themselves add up to offsets."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    lengths = F.transform(value, F.length) if group else whole
    zipped = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(1))).alias("gap"), whole.alias("whole"), lengths.alias("counted"))

    def step(acc: Column, m: Column) -> Column:
        begin = (acc["at"] + m["gap"]).cast("int")
        end = (begin + m["whole"]).cast("int")
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(m["counted"] >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    length = lambda part: F.aggregate(part, F.lit(0), lambda acc, m: (acc + m["gap"] + m["whole"]).cast("int"))

    def spans_of(z: Column) -> Column:
        start = F.struct(z["carry"].cast("int").alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(z["part"], start, step, lambda acc: acc["found"])

    found = F.flatten(F.transform(_with_carry(zipped, length, lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)), spans_of))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    parts = [_spans(text, kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(RULES)]
    return F.array_sort(F.concat(*parts))


def _symbols(token: Column) -> Column:
    """Numbers of a token's characters; 0 for those outside the alphabet and for the start."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0)), F.transform(letters, lambda c: F.call_function("locate", c, F.lit(ALPHABET))))


def samples_of(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples (value, secret, held) from about `most` documents picked by a hash of doc_id: what the rules
    capture and digests of the picked ids are secrets; see `ordinary_tokens` for the others. `held` ones choose the
    threshold, the others train."""
    total = max(1, docs.count())
    chance = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1_000_000
    picked = docs.filter(chance(7) < min(1.0, most / total)).select("doc_id", "text", (chance(8) < HELD_OUT).alias("held"))
    digest = F.sha2(F.concat(F.lit("sample:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    base64 = F.base64(F.unhex(digest))
    made = picked.select(F.explode(F.array(base64, F.translate(base64, "+/", "-_"), F.substring(digest, 1, 40), F.upper(F.substring(F.translate(base64, "+/=", ""), 1, 20)))).alias("value"), F.lit(1).alias("secret"), "held")
    rule = [F.regexp_extract_all("text", F.lit(p), F.lit(g)) for _, p, g, _ in RULES]
    long_enough = [F.filter(r, lambda v, n=n: F.length(v) >= n) for r, (_, _, _, n) in zip(rule, RULES)]
    caught = picked.select(F.explode(F.concat(*long_enough)).alias("value"), F.lit(1).alias("secret"), "held")
    ordinary = ordinary_tokens(picked).select("value", F.lit(0).alias("secret"), "held")
    return made.unionByName(caught).unionByName(ordinary)


def ordinary_tokens(docs: DataFrame) -> DataFrame:
    """value, held: ordinary tokens of docs (doc_id, text, held). Each kind of long clean token is made of groups of
    four words, of the document or the fixed ones, and of numbers and dates dealt by its doc_id; its own shorter tokens outside the rules'
    matches come as they are."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "|".join(p.replace("((?:", "(?:(?:") for _, p, _, _ in RULES), " ")
    tokens = docs.select("doc_id", "held", F.explode(F.array(clean)).alias("clean")).select("doc_id", "held", F.explode(F.array(F.regexp_extract_all("clean", F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0)))).alias("tokens"))
    short = F.filter("tokens", lambda t: (F.length(t) >= 8) & (F.length(t) < 20) & t.rlike("[0-9/_=+-]|[a-z][A-Z]"))
    words = F.filter("tokens", lambda t: t.rlike("^[A-Za-z]{2,14}$"))
    parts = tokens.select("doc_id", "held", F.explode(F.array(F.struct(words.alias("words"), short.alias("short")))).alias("p")).select("doc_id", "held", "p.*")
    step = F.floor((F.size("words") - 4) / GROUPS).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda i: F.struct(i.alias("i"), F.transform(F.slice("words", i * F.greatest(step, F.lit(0)) + 1, 4), F.lower).alias("w")))
    grouped = parts.select("doc_id", "held", F.explode(groups).alias("g")).select("doc_id", "held", "g.*")
    fixed = F.split(F.lit(" ".join(IDENTIFIERS)), " ")
    dealt = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.element_at(fixed, (F.pmod(F.xxhash64("doc_id", "i", n), F.lit(len(IDENTIFIERS))) + 1).cast("int")))
    grouped = grouped.withColumn("w", F.when(F.col("i") % 2 == 1, dealt).otherwise(F.col("w")))
    number = lambda seed, below: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "i"), F.lit(below))
    digits = lambda seed, n: F.lpad(number(seed, 10**n).cast("string"), n, "0")
    day = lambda seed, form: F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), number(seed, 14_000).cast("int")), form)
    wordless = [
        F.concat(digits(1, 10), digits(2, 12)),
        F.concat(day(3, "yyyy-MM-dd"), F.lit("/"), day(4, "yyyy-MM-dd"), F.lit("/"), digits(5, 3)),
        F.concat(day(3, "yyyyMMdd"), F.lit("-"), digits(6, 6), F.lit("_"), digits(7, 6)),
        F.repeat(F.element_at(F.array(*map(F.lit, "-=_+/")), (number(8, 5) + 1).cast("int")), (number(9, 20) + 20).cast("int")),
    ]
    big, one = F.transform("w", F.initcap), lambda i: F.get("w", F.lit(i))
    worded = [
        F.array_join("w", ""),
        F.concat(one(0), F.array_join(F.slice(big, 2, 3), "")),
        F.array_join(big, ""),
        F.array_join("w", "_"),
        F.upper(F.array_join("w", "_")),
        F.concat(F.upper(F.array_join(F.slice("w", 1, 3), "_")), F.lit("="), F.when(number(14, 2) == 0, one(3)).otherwise(F.initcap(one(3)))),
        F.concat(F.array_join("w", "-"), F.lit("-"), digits(10, 4)),
        F.concat(F.lit("/"), F.array_join("w", "/")),
        F.concat(F.lit("/"), one(0), F.lit("/"), F.initcap(one(1)), F.lit("/"), F.initcap(one(2)), F.initcap(one(3)), F.lit("/"), day(11, "yyyy")),
        F.concat(F.lit("/"), one(0), F.lit("/"), day(12, "yyyy/MM/dd"), F.lit("/"), one(1), F.lit("-"), one(2), F.lit("-"), digits(13, 7)),
    ]
    made = grouped.select("held", F.explode(F.concat(F.array(*wordless), F.when(F.size("w") == 4, F.array(*worded)).otherwise(F.array().cast("array<string>")))).alias("value"))
    return made.unionByName(parts.select("held", F.explode("short").alias("value")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each (previous, current) character, random over ordinary: SIDE * SIDE numbers.

    Counting is distributed; what the driver gets has a row for each label and pair of characters at most.
    """
    codes = samples.filter("not held").select("secret", _symbols(F.col("value")).alias("codes"))
    pair = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.element_at("codes", i) * SIDE + F.element_at("codes", i + 1))
    counted = codes.filter(F.size("codes") > 1).select("secret", F.explode(pair).alias("pair")).groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n"))
    table = {0: [SMOOTHING] * (SIDE * SIDE), 1: [SMOOTHING] * (SIDE * SIDE)}
    for r in counted.collect():
        table[r["secret"]][r["pair"]] += r["n"]
    def logs(cells: list[float]) -> list[float]:
        rows = [sum(cells[i * SIDE : (i + 1) * SIDE]) for i in range(SIDE)]
        return [math.log(c / rows[i // SIDE]) for i, c in enumerate(cells)]

    return [a - b for a, b in zip(logs(table[1]), logs(table[0]))]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a token."""
    cells = F.from_json(F.lit(json.dumps([round(x, 9) for x in model])), "array<double>")  # a literal array: as many numbers as the model has
    total = F.aggregate(
        _symbols(token),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(cells, (acc["last"] * SIDE + c + 1).cast("int")))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.length(token)


def threshold(samples: DataFrame, model: list[float]) -> float:
    """The mean ratio with the smallest sum of both kinds' error rates on the held-out samples of a token's length;
    the middle of several. The driver gets counts by hundredths of the ratio."""
    bins = samples.filter("held and length(value) >= 20").groupBy("secret", F.floor(mean_ratio(F.col("value"), model) * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in bins.collect():
        counts[r["secret"]][r["bin"]] = r["n"]
    totals = [sum(counts[k].values()) for k in (0, 1)]
    if not all(totals):
        return LEAST_RATIO
    low, high = min(min(c) for c in counts.values()), max(max(c) for c in counts.values())
    wrong, errors = 1.0, {}
    for cut in range(low, high + 2):  # secret: bins from `cut` on
        errors[cut] = wrong
        wrong += counts[1].get(cut, 0) / totals[1] - counts[0].get(cut, 0) / totals[0]
    best = [c for c, e in errors.items() if e <= min(errors.values()) + 1e-12]
    return (best[0] + best[-1]) / 200


def with_spans(docs: DataFrame, model: list[float], text: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """docs with `base` and `added` span arrays."""
    t = F.coalesce(F.col(text), F.lit(""))
    token = _spans(t, ADDED, len(RULES), TOKEN, 0, 20)
    values = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    out = docs.withColumn("base", base_spans(t)).withColumn("_token", F.arrays_zip(token.alias("span"), values.alias("value")))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    strong = F.filter("_token", lambda x: free(x["span"]) & (mean_ratio(x["value"], model) >= least))
    return out.withColumn("added", F.transform(strong, lambda x: x["span"])).drop("_token")


def scan(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with `base` and `added` spans (start, rank, end, kind)."""
    samples = samples_of(docs if learn_from is None else learn_from)
    model = train(samples)
    return with_spans(docs, model, least=threshold(samples, model))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span replaced by `mark`; overlapping spans are replaced as one."""

    def step(acc: Column, s: Column) -> Column:
        # positions inside the part's own stretch of text, which begins at `from`
        fresh = F.concat(acc["done"], F.substr(acc["text"], acc["at"] - acc["from"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        done = F.when(s["start"] < acc["at"], acc["done"]).otherwise(fresh)
        return F.struct(acc["from"].alias("from"), acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"), done.alias("done"))

    last = lambda part: F.array_max(F.transform(part, lambda s: s["end"]))

    def piece(z: Column) -> Column:
        stretch = F.substr(text, z["carry"] + 1, F.greatest(last(z["part"]) - z["carry"], F.lit(0)))
        start = F.struct(z["carry"].alias("from"), stretch.alias("text"), z["carry"].alias("at"), F.lit("").alias("done"))
        return F.aggregate(z["part"], start, step, lambda acc: acc["done"])

    parts = _with_carry(spans, last, lambda a: F.coalesce(F.array_max(a), F.lit(0)))
    body = F.concat(F.array_join(F.transform(parts, piece), ""), F.substr(text, last(spans) + 1))
    return F.when(F.size(spans) > 0, body).otherwise(text)


def op7_secret_scan(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind, *_ in RULES],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@own_columns
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are replaced by a mark and n_chars follows."""
    names = docs.columns
    clean = scan(docs).withColumn("_text", redacted(F.col("text"), F.array_sort(F.concat("base", "added"))))
    changed = F.size(F.concat("base", "added")) > 0
    out = {"text": F.col("_text"), "n_chars": F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in names else None}
    return clean.select(*[out[c].alias(c) if c in out else F.col(c) for c in names])
