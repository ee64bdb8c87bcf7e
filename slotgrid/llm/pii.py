"""Personal data: high-recall generators, gradient-boosted trees over format and context, calibrated thresholds. DataFrame functions only."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gbdt import Forest, fit
from .scratch import Scratch

# The base patterns in the order their spans are listed. Possessive forms and look-behinds only save
# retries at places that cannot match; \G keeps a match that starts right after the one before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates; their spans may overlap each other and the base ones. None has an upper length: a
#: long run of numbers is proposed in pieces that end between two of them (a rest too short for a piece goes to the one
#: before), a longer number as a whole.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])(?:[0-9(][0-9().\x20/-]{6,30}[0-9](?![0-9A-Za-z])(?:(?![0-9().\x20/-]{9})[0-9().\x20/-]*[0-9](?![0-9A-Za-z]))?|[0-9]{32,}+(?![A-Za-z]))",
    "spoken_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{2,}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,}+)++",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+",
}
#: Words in the 24 characters before a candidate that speak for it.
HINTS = r"(?i)(?<![A-Za-z])(?:phone|telephone|tel|mobile|call|fax|ssn|social|card|account|iban|passport|e?mail|contact|token|secret|passw|api|key|auth|credential)"
# What stands before planted spans, and before planted text that only looks like one.
LEADS = {
    "number": ["phone ", "call ", "tel: ", "mobile ", "my ssn is ", "account no. ", "fax ", ""],
    "spoken_email": ["mail ", "contact ", "write to ", "or ", ""],
    "secret": ['token = "', "api_key: ", "password=", "secret ", "auth: ", 'key="'],
}
PLAIN_LEADS = {"number": ["on ", "in ", "page ", "since ", "about ", ""], "secret": ["build ", "commit ", "see ", "file ", ""]}
#: Most distinct candidates the trees are fitted on, about, shared evenly by the kinds. Most of the held-out false candidates of a kind that a threshold may let through, as a share of them.
TRAIN_CANDIDATES = 20_000
FALSE_SHARE = 0.05
#: Limits are log-odds on a grid of so many steps a unit, from 0 up; scores beyond the last step count as that.
STEPS, TOP = 64, 30
SPAN = "array<struct<start:bigint,stop:bigint,found:string,before:string>>"
FEATURES = ["size", "digits", "letters", "upper", "separators", "groups", "hex", "dots", "at", "hint", "equals", "plus"]


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point places, end exclusive, and up to 24 characters before each.

    Splitting at the pattern and extracting it give the pieces between and the matches; their lengths add up to the places.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def length(x: Column) -> Column:
        return F.char_length(x["piece"]) + F.coalesce(F.char_length(x["found"]), F.lit(0))

    def step(seen: Column, x: Column) -> Column:
        begin = seen["at"] + F.char_length(x["piece"])
        stop = begin + F.coalesce(F.char_length(x["found"]), F.lit(0))
        one = F.struct(begin.alias("start"), stop.alias("stop"), x["found"].alias("found"), F.right(x["piece"], F.lit(24)).alias("before"))
        return F.struct(stop.cast("long").alias("at"), F.when(x["found"].isNull(), seen["out"]).otherwise(F.concat(seen["out"], F.array(one).cast(SPAN))).alias("out"))

    def spans(pieces: Column) -> Column:
        """Slices of about the square root of the pieces: first where each begins, then the places within each, so no long array grows piece by piece."""
        n = F.size(pieces)
        wide = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<i:int,at:bigint>>").alias("out"))

        def begin(seen: Column, i: Column) -> Column:
            total = F.aggregate(F.slice(pieces, i + 1, wide), F.lit(0), lambda t, x: t + length(x))
            one = F.array(F.struct(i.alias("i"), seen["at"].alias("at")).cast("struct<i:int,at:bigint>"))
            return F.struct((seen["at"] + total).alias("at"), F.concat(seen["out"], one).alias("out"))

        def within(s: Column) -> Column:
            start = F.struct(s["at"].alias("at"), F.array().cast(SPAN).alias("out"))
            return F.aggregate(F.slice(pieces, s["i"] + 1, wide), start, step, lambda t: t["out"])

        return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(0), n - 1, wide), zero, begin, lambda s: s["out"]), within))

    # the outer lambda cuts the text once
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(F.array(both), spans)[0]).otherwise(F.array().cast(SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """The check a base match must pass."""
    found = x["found"]
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= F.lit(3)) & F.forall(
            F.split(found, r"\."), lambda p: F.substring(F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0"), 1, 3) <= F.lit("255")
        )
    digits = _digits(found)
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: F.filter(matches(text, p), partial(valid, kind)) for kind, p in BASE.items()}


def features(x: Column) -> list[Column]:
    """Numbers about the format of a candidate and what stands before it."""
    found, size = x["found"], F.char_length(x["found"])

    def count(pattern: str) -> Column:
        return F.regexp_count(found, F.lit(pattern))

    return [
        c.cast("double")
        for c in (
            size, count("[0-9]") / size, count("[A-Za-z]") / size, count("[A-Z]") / size, count(r"[\x20/-]"), count("[0-9]+"), count("[0-9a-f]") / size,
            count(r"\."), count("@|at[)}]|at\\]").cast("int"), F.regexp_like(x["before"], F.lit(HINTS)).cast("int"), F.regexp_like(x["before"], F.lit("[=:]\\s*\"?$")).cast("int"), F.endswith(x["before"], F.lit("+")).cast("int"),
        )
    ]


def planted(text: Column, base: dict[str, Column]) -> Column:
    """Candidates made for one text: array of struct(kind, found, before, one), `one` telling personal data from what only looks like it.

    Each stands in the text's own context: after the words before a place that a hash chooses, with a lead word or none.
    The checked phone and e-mail of a text serve as well, written without the sign their pattern asks for, where they stand.
    """
    h = F.xxhash64(text, F.lit("plant"))
    at = F.pmod(h, F.greatest(F.char_length(text), F.lit(1))).cast("int")
    context = F.regexp_replace(F.substring(text, F.greatest(at - 32, F.lit(1)), F.lit(32)), r"\S*$", "")

    def number(salt: str, below: int) -> Column:
        return F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(below))

    def one_of(salt: str, options: list[Column]) -> Column:
        return F.get(F.array(*options), number(salt, len(options)).cast("int"))

    def filled(salt: str, wide: int, low: int, high: int) -> Column:
        return F.lpad((number(salt, high - low + 1) + low).cast("string"), wide, "0")

    ten = F.lpad(number("digits", 10**10).cast("string"), 10, "0")
    cut = [F.regexp_replace(ten, "(.{3})(.{3})(.{4})", form) for form in ("$1-$2-$3", "($1) $2-$3", "$1 $2 $3", "$1.$2.$3", "$1$2$3")]
    year, month, day = filled("year", 4, 1800, 2050), filled("month", 2, 1, 12), filled("day", 2, 1, 28)
    amount = F.regexp_replace(F.substring(ten, 1, 9), "(.{3})(.{3})(.{3})", "$1 $2 $3")
    dates = [F.concat_ws("-", year, month, day), F.concat_ws("/", day, month, year), F.concat_ws(" - ", year, filled("until", 4, 1800, 2050))]
    digest = F.sha2(h.cast("string"), 256)
    letters = F.translate(F.hex(h), "0123456789ABCDEF", "aeioulnrstmkpdbg")
    mixed = [F.concat(letters, ten), F.concat(F.substring(ten, 1, 6), letters, F.reverse(letters)), F.concat(F.substring(letters, 1, 9), ten, F.substring(digest, 1, 9)), F.concat(F.substring(letters, 1, 4), ten, ten)]
    written = F.concat(
        F.substring(letters, 1, 7), one_of("sign", [F.lit(x) for x in (" (at) ", "(at)", " [at] ")]),
        F.substring(letters, 8, 6), one_of("dot", [F.lit(x) for x in (" (dot) ", "(dot)", ".")]), one_of("end", [F.lit(x) for x in ("com", "org", "net", "de")]),
    )
    named = F.concat(F.lit("section-"), F.regexp_replace(context, "[^A-Za-z]+", "-"), filled("part", 3, 1, 999), F.lit("-part"))
    values = [
        ("number", True, one_of("form", [*cut, F.regexp_replace(F.substring(ten, 1, 9), "(.{3})(.{2})(.{4})", "$1-$2-$3")])),
        ("number", False, one_of("plain", [*dates, amount, F.concat(F.substring(ten, 1, 1), F.lit("."), F.substring(ten, 2, 8)), ten])),
        ("spoken_email", True, written),
        ("secret", True, one_of("long", [F.substring(digest, 1, 32), F.substring(digest, 1, 40), digest, F.base64(F.unhex(digest)), F.concat(F.lit("sk-"), F.substring(digest, 1, 24)), *mixed])),
        ("secret", False, one_of("short", [F.substring(digest, 1, 40), F.substring(digest, 1, 32), named, named])),
    ]
    made = []
    for kind, one, value in values:
        lead = one_of(f"lead {kind} {one}", [F.lit(x) for x in (LEADS if one else PLAIN_LEADS)[kind]])
        made.append((kind, one, value, F.right(F.concat(context, lead), F.lit(24))))
    for kind, of, change in (("number", "phone", lambda x: F.substring(x, 2, 1 << 20)), ("spoken_email", "email", lambda x: F.replace(F.replace(x, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")))):
        first = F.get(base[of], 0)
        made.append((kind, True, change(first["found"]), first["before"]))
    all_made = F.array(*[F.struct(F.lit(k).alias("kind"), value.alias("found"), before.alias("before"), F.lit(one).alias("one")) for k, one, value, before in made])
    return F.filter(all_made, lambda x: x["found"].isNotNull())


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))


def train(docs: DataFrame, text: str, rows: int = TRAIN_CANDIDATES) -> tuple[Forest, dict[str, float]]:
    """Trees, fitted on about `rows` distinct candidates at most, and the least log-odds of each generator, set over all candidates.

    Three things teach: base matches, whose check the features do not show; spans planted in each text's own context,
    personal data and look-alikes (`planted`); and what the generators find in the texts, which counts as false
    unless a base span overlaps it or a hint or an assignment stands before it: then nobody knows, and it teaches nothing.
    Candidates alike in kind and features are one cell with its counts, in which a text counts once, whatever its copies. A hash of the text halves the documents, so copies
    stay together: one half fits, the other sets each limit: the lowest at which at most `FALSE_SHARE` of the found and of the planted
    false candidates pass that no hint or assignment precedes, or infinity. The mostly true and the mostly false cells of a kind have half its room each; too many of them keep each with a chance in proportion to its count, and always those
    of many copies; the weights make up for it, and give the true and the false of a kind the same sum.
    """
    body = F.col(text)
    held = docs.select(F.xxhash64(body).alias("hash"), body.alias("body"), *[matches(body, p).alias(k) for k, p in BASE.items()])
    held = held.select("*", *[F.filter(k, partial(valid, k)).alias(f"good_{k}") for k in BASE])
    held = held.withColumn("base", F.concat(*[f"good_{k}" for k in BASE]))

    def cell(kind: Column, one: Column, made: bool, x: Column) -> Column:
        return F.struct(kind.alias("kind"), F.coalesce(one, F.lit(False)).alias("one"), F.lit(made).alias("made"), *[f.alias(n) for n, f in zip(FEATURES, features(x))])

    def of_base(kind: str):
        return lambda x: cell(F.lit(kind), valid(kind, x), False, x)

    def of_generator(kind: str):
        return lambda x: cell(F.lit(kind), F.lit(False), False, x)

    each = [F.transform(k, of_base(k)) for k in BASE]
    for kind, p in GENERATORS.items():
        free = F.filter(matches(F.col("body"), p), lambda x: ~overlaps(x, F.col("base")))
        each.append(F.transform(free, of_generator(kind)))
    each.append(F.transform(planted(F.col("body"), {k: F.col(f"good_{k}") for k in BASE}), lambda x: cell(x["kind"], x["one"], True, x)))
    found = held.select("hash", F.explode(F.flatten(F.array(*each))).alias("c")).select("hash", "c.*")
    bare = (F.col("hint") == 0) & (F.col("equals") == 0)
    known = F.col("made") | F.col("kind").isin(list(BASE)) | bare
    fits = F.pmod(F.xxhash64("hash"), F.lit(2)) == 0
    sums = {"n": fits, "ones": fits & F.col("one"), "held": ~fits, "held_found": ~fits & ~F.col("one") & ~F.col("made"), "held_made": ~fits & ~F.col("one") & F.col("made") & bare}
    cells = Scratch(docs.sparkSession, "pii").keep(found.where(known).distinct().groupBy("kind", *FEATURES).agg(*[F.count_if(c).alias(k) for k, c in sums.items()]))
    share = max(1, rows // (len(BASE) + len(GENERATORS)))
    used = cells.where("n > 0").withColumn("true", F.col("ones") * 2 >= F.col("n"))
    sizes = used.groupBy("kind", "true").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
    many, even = F.lit(0.0), F.lit(1.0)
    for r in sizes:
        if r["cells"] > share / 2:
            many = F.when((F.col("kind") == r["kind"]) & (F.col("true") == F.lit(r["true"])), F.lit(2 * r["n"] / share)).otherwise(many)
    # cells of many copies stay anyway, so the others share what is left
    heavy = used.where(F.col("n") >= many).groupBy("kind", "true").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n")).collect()
    heavy = {(r["kind"], r["true"]): r for r in heavy}
    for r in sizes:
        own = heavy.get((r["kind"], r["true"]))
        if r["cells"] > share / 2 and own and r["cells"] > own["cells"]:
            left = (r["n"] - own["n"]) / max(1.0, share / 2 - own["cells"])
            many = F.when((F.col("kind") == r["kind"]) & (F.col("true") == F.lit(r["true"])), F.lit(left)).otherwise(many)
    for kind in {r["kind"] for r in sizes}:
        n, ones = (sum(r[c] for r in sizes if r["kind"] == kind) for c in ("n", "ones"))
        if 0 < ones < n:
            even = F.when(F.col("kind") == kind, F.lit((n - ones) / ones)).otherwise(even)
    chance = F.pmod(F.xxhash64("kind", *FEATURES), F.lit(1 << 30)) / float(1 << 30)
    sample = used.withColumn("weight", F.greatest(F.col("n").cast("double"), many)).where(chance * F.col("weight") < F.col("n"))
    ones, rest = F.col("ones") * even, F.col("n") - F.col("ones")
    sample = sample.select(*FEATURES, "kind", (F.col("weight") / F.col("n") * (ones + rest)).alias("weight"), (ones / (ones + rest)).alias("label"))
    sample = sample.toArrow().sort_by([(c, "ascending") for c in [*FEATURES, "kind"]])
    x = np.stack([sample[f].to_numpy() for f in FEATURES], axis=1) if len(sample) else np.zeros((0, len(FEATURES)))
    y, weights = (sample[c].to_numpy() if len(sample) else np.zeros(0) for c in ("label", "weight"))
    forest = fit(x, y, weights, trees=20, depth=4, rate=0.3, bins=32)
    scored = cells.where(F.col("kind").isin(list(GENERATORS)) & (F.col("held") > 0)).select("kind", "held_found", "held_made", F.struct(*FEATURES).alias("x"))
    step = F.greatest(F.least(F.floor(F.expr(raw_score(forest)) * STEPS), F.lit(STEPS * TOP)), F.lit(-1)).cast("long")
    passing = scored.select("kind", "held_found", "held_made", step.alias("step")).groupBy("kind", "step").agg(F.sum("held_found").alias("found"), F.sum("held_made").alias("made"))
    steps = sorted(passing.collect(), key=lambda r: -r["step"])
    limits = dict.fromkeys(GENERATORS, float("inf"))
    for name in GENERATORS:
        own = [r for r in steps if r["kind"] == name]
        most = {k: FALSE_SHARE * sum(r[k] for r in own) for k in ("found", "made")}
        passed, tight = dict.fromkeys(most, 0), -1
        for r in own:
            passed = {k: n + r[k] for k, n in passed.items()}
            if any(passed[k] > most[k] for k in most):
                tight = r["step"]
                break
        if own and own[0]["step"] > tight:
            limits[name] = (tight + 1) / STEPS
    return forest, limits


def _tree(forest: Forest, node: int) -> str:
    if forest.feature[node] < 0:
        return f"{float(forest.value[node])!r}D"
    name, left = FEATURES[forest.feature[node]], int(forest.left[node])
    return f"if(x.{name} <= {float(forest.cut[node])!r}D, {_tree(forest, left)}, {_tree(forest, left + 1)})"


def raw_score(forest: Forest) -> str:
    """SQL for the log-odds of a struct `x` of features: each tree is a nest of conditions."""
    return " + ".join([f"{forest.base!r}D", *[_tree(forest, int(r)) for r in forest.roots]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): arrays of struct(kind, start, stop), one row per row of `docs`, whole texts.

    `base` holds the checked base matches by kind as in `BASE`, then start; `spans` those and the candidates whose score
    reaches the limit of their generator, base kinds first. Places are code points, ends exclusive. A candidate that
    overlaps a base span or an earlier one of its own kind is not added. Null texts count as empty; ids may be null or repeat; other columns
    are not read; an empty table gives an empty one.
    """
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    forest, limits = train(body, "text")
    base = body.select("id", "text", *[s.alias(k) for k, s in base_spans(F.col("text")).items()])

    def tagged(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))

    base = base.withColumn("base", F.concat(*[tagged(k, F.col(k)) for k in BASE]))
    more = []
    for kind, pattern in GENERATORS.items():
        least = limits[kind]
        if least == float("inf"):
            continue
        free = F.filter(matches(F.col("text"), pattern), lambda x: ~overlaps(x, F.col("base")))
        cells = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), *[f.alias(n) for n, f in zip(FEATURES, features(x))]))
        base = base.withColumn(f"_{kind}", cells)
        more.append(tagged(kind, F.expr(f"filter(_{kind}, x -> {raw_score(forest)} >= {least!r}D)")))
    return base.select(F.col("id").alias(id_col), "base", (F.concat("base", *more) if more else F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
