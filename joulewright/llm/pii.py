r"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions find spans of four kinds. The base spans follow fixed rules and always
count. Looser patterns propose candidates that those rules miss (a number that a longer
run of digits swallows, a number in national form, an address spelled out), and labelers
vote on every span, base or not: its form, its check (Luhn, part sizes, number of digits),
gazetteers (issuer prefixes, calling codes, top-level domains), cue words before it, words
that speak against it, and what it touches. Expectation-maximisation estimates from the
votes alone how reliable each labeler is; a logistic span classifier is then trained on
the posteriors and decides which candidates are added.

The text is read in one narrow pass, whose spans and votes are written once. Votes are
counted by pattern, at most 3 ** 6 of them, so both models are folds over one small array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import materialize, read, text_of, tidy

KINDS = ("email", "ip", "card", "phone")
NO_VOTE, YES, NO = 0, 1, 2
LABELERS = 6
#: A labeler that votes is taken to be right this often, as if seen PRIOR_N times before.
PRIOR_RIGHT, PRIOR_N = 0.85, 20.0
EM_ROUNDS, STEPS, RATE, SHRINK = 25, 150, 1.0, 0.01

#: The base rules. Possessive quantifiers and what may stand before a match change no match;
#: they keep the scan linear and free of recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates beside them; at most one pattern a kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: A cheap test that every text with a match passes, and one without mostly fails.
HINT = {"email": "@", "phone": "+"}
LOOSE_HINT = {"email": "at", "ip": ":"}
#: The same as a pattern, where no single text is in every match.
LOOSE_HINT_PATTERN = {"phone": "[0-9][.-][0-9]{4}"}

ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING = r"^(?:\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{4})|\(|[2-9])"
DOMAINS = r"(?i)[.\])} ](?:com|org|net|edu|gov|int|io|info|biz|co|eu|uk|de|fr|es|it|nl|us|ca|au|jp|cn|in|br|ru|ch|at|be|se|no|pl)$"
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|from|to:)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|from|login)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|master|amex|pay|credit|debit)\W*\w*\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|cell|contact)\W*\w*\W*$",
}
AGAINST = r"(?i)(?:isbn|issn|doi|order|invoice|serial|sku|version|build|tracking|ticket|no\.|nr\.|\bv)\W*$"


def sorted_out(text: Column, pattern: str, hint: str | None, hint_pattern: str | None = None) -> Column:
    """array<struct<start, end, m>> of the leftmost, non-overlapping matches, in code points."""
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    # a match and the text before it
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    found = F.when(F.size(matches) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]).otherwise(none)
    if hint_pattern:
        return F.when(text.rlike(hint_pattern), found).otherwise(none)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(none) if hint else found


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.when(F.length(d) > 0, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0).otherwise(False)


def check(kind: str, m: Column) -> Column:
    """The rule that a match must pass besides its form."""
    if kind == "ip":
        small = F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
        return F.contains(m, F.lit(":")) | small
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, YES).when(F.lit(True) if no is None else no, NO if no is not None else NO_VOTE).otherwise(NO_VOTE)


def votes(kind: str, text: Column, s: Column) -> Column:
    """What the labelers say of a span; the order is that of the reliabilities."""
    m = s["m"]
    before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    left, right = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(" "), F.substring(text, s["end"] + 1, F.lit(1))
    strict = {
        "email": m.rlike(r"^[A-Za-z0-9._%+-]{2,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
        "ip": m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|:"),
        "card": m.rlike(r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"),
        "phone": m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"),
    }[kind]
    listed = {
        "email": m.rlike(DOMAINS),
        "ip": ~m.rlike(r"^(?:0+\.|255\.|127\.)"),
        "card": m.rlike(ISSUERS),
        "phone": m.rlike(CALLING),
    }[kind]
    return F.array(
        vote(strict, ~strict),
        vote(check(kind, m), ~check(kind, m)),
        vote(listed),
        vote(before.rlike(CUES[kind])),
        vote(F.lit(False), before.rlike(AGAINST)),
        vote(F.lit(False), left.rlike(r"[A-Za-z0-9=/#_]") | right.rlike(r"[A-Za-z0-9=/#_@]")),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of kind, start, end, base, votes. Base spans first, then those beside them."""
    t = text_of(docs, id_col, text_col)
    text = F.col("text")
    for k in KINDS:
        good = F.filter(sorted_out(text, BASE[k], HINT.get(k)), passing(k))
        t = t.withColumn(f"base_{k}", good).withColumn(f"loose_{k}", sorted_out(text, LOOSE[k], LOOSE_HINT.get(k), LOOSE_HINT_PATTERN.get(k)))
    parts = []
    for k in KINDS:
        fresh = F.filter(f"loose_{k}", apart_from(f"base_{k}"))
        parts += [F.transform(f"base_{k}", voted(k, text, True)), F.transform(fresh, voted(k, text, False))]
    return t.select("doc_id", F.concat(*parts).alias("spans"))


def passing(kind: str):
    return lambda s: check(kind, s["m"])


def apart_from(spans: str):
    return lambda s: ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def voted(kind: str, text: Column, base: bool):
    n = KINDS.index(kind)
    return lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), votes(kind, text, s).alias("votes"))


def of_kind(n: int):
    return lambda s: s["base"] & (s["kind"] == n)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + of(x))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def slot(labeler: Column | int, v: Column | int) -> Column:
    """The place of a labeler's vote in an array of LABELERS * 3 values, from 0."""
    return F.lit(labeler) * 3 + v


def posterior(state: Column, pattern: Column) -> Column:
    """How likely a span with these votes is personal data."""
    z = F.log(state["prior"] / (1 - state["prior"]))
    for i in range(LABELERS):
        at = slot(i, pattern["votes"][i])
        z = z + F.log(F.get(state["yes"], at) / F.get(state["no"], at))
    return sigmoid(z)


def estimate(patterns: Column) -> Column:
    """struct<prior, yes, no>: P(vote | personal data) and P(vote | not) of each labeler, by expectation-maximisation."""
    right = [1 / 3, PRIOR_RIGHT * 2 / 3, (1 - PRIOR_RIGHT) * 2 / 3]
    yes0 = F.array(*[F.lit(x) for x in right * LABELERS])
    no0 = F.array(*[F.lit(right[v]) for v in (0, 2, 1) * LABELERS])
    start = F.struct(F.lit(0.5).alias("prior"), yes0.alias("yes"), no0.alias("no"))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * posterior(state, p)).alias("y")))

        def update(w: Column) -> Column:
            def rates(prior: Column, mass) -> Column:
                def rate(k: Column) -> Column:
                    labeler = F.floor(k / 3).cast("int")
                    hit = total(w, lambda p: F.when(F.get(p["votes"], labeler) == k % 3, mass(p)).otherwise(0.0))
                    return (hit + PRIOR_N * F.get(prior, k)) / (total(w, mass) + PRIOR_N)

                return F.transform(F.sequence(F.lit(0), F.lit(LABELERS * 3 - 1)), rate)

            prior = (total(w, lambda p: p["y"]) + PRIOR_N / 2) / (total(w, lambda p: p["n"]) + PRIOR_N)
            return F.struct(prior.alias("prior"), rates(yes0, lambda p: p["y"]).alias("yes"), rates(no0, lambda p: p["n"] - p["y"]).alias("no"))

        return let(weighed, update)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step)


def score(weights: Column, votes_: Column) -> Column:
    z = F.get(weights, F.lit(LABELERS * 3))
    for i in range(LABELERS):
        z = z + F.get(weights, slot(i, F.get(votes_, F.lit(i))))
    return sigmoid(z)


def train(labelled: Column) -> Column:
    """The classifier's weights (one for each labeler's vote, then the intercept), by gradient descent on soft labels."""
    zero = F.transform(F.sequence(F.lit(0), F.lit(LABELERS * 3)), lambda _: F.lit(0.0))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform(labelled, lambda p: F.struct(p["votes"].alias("votes"), (p["n"] * (score(w, p["votes"]) - p["y"])).alias("e")))

        def update(e: Column) -> Column:
            def moved(k: Column) -> Column:
                own = lambda p: F.when((k == LABELERS * 3) | (F.get(p["votes"], F.floor(k / 3).cast("int")) == k % 3), p["e"]).otherwise(0.0)
                return F.get(w, k) - RATE * (total(e, own) / F.greatest(total(labelled, lambda p: p["n"]), F.lit(1.0)) + SHRINK * F.get(w, k))

            return F.transform(F.sequence(F.lit(0), F.lit(LABELERS * 3)), moved)

        return let(errors, update)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step)


def fit(found: DataFrame) -> list[float]:
    """The weights of the span classifier, from the votes on all spans of the corpus."""
    counted = found.select(F.explode("spans.votes").alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most 3 ** LABELERS patterns
    one = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    known = one.withColumn("state", estimate(F.col("patterns")))
    labelled = known.select(F.transform("patterns", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(F.col("state"), p).alias("y"))).alias("labelled"))
    return labelled.select(train(F.col("labelled")).alias("weights")).first()["weights"]


def joined(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@tidy
def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the base spans; spans has those and the added ones,
    which the classifier gives `threshold` or more. Offsets are in code points, ends
    exclusive. Null and empty texts have no spans; the scan of a text is linear in its
    length; null ids stay null; repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    found = materialize(candidates(docs, id_col, text_col), "spans")
    weights = F.array(*[F.lit(float(w)) for w in fit(found)])
    base = F.filter("spans", lambda s: s["base"])
    kept = F.filter("spans", lambda s: s["base"] | (score(weights, s["votes"]) >= threshold))
    counts = [F.size(F.filter("spans", of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(kept).alias("spans"), (F.size(kept) - F.size(base)).cast("long").alias("n_added")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
