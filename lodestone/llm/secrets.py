"""Secret scans: known forms by patterns, unknown ones by a battery of randomness tests. DataFrame functions only.

Known forms are assignments to a secret's name, access keys and long hex strings. Beside them, any run of key
characters that holds letters and digits is a candidate. Its encoding is inferred from the characters it uses (hex,
base32, base36, base62, both kinds of base64), and under that encoding three tests ask if it could be uniformly random:
chi-squared over the alphabet (its symbols, or, where FULL of each aren't to be expected, lower case, upper case and the
rest), the runs above and below the alphabet's middle, and the correlation of neighbours. Fisher's method combines their
p-values; what falls below LEVEL is no random string and is never reported.

For what is left the question is turned round, as it is ordinary strings among those reported that do harm. An
ordinary string (identifier, slug, path, version) is made of words and numbers: it goes over from letters to digits, or
from lower to upper case, at no more than a share CHANGES of its places, and no more than a share RARE of its letters
are among j k q v w x y z. Under that hypothesis the two numbers have binomial tails, and Fisher's method combines
them. Benjamini-Hochberg over all candidates of one encoding and length class then bounds the share of ordinary
strings among those reported by ``rate``. Short strings have little power, so in a class with many ordinary strings
only long or many random ones stand out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import stored

# The known forms, in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")  # any match holds one of them, in either case
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more characters, from the start of its run
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ENCODINGS = (  # name, what it matches, its alphabet in order
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/]+$", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", r"^[0-9A-Za-z_-]+$", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
    ("mixed", r"^.+$", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
TURN = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"  # a capital at the head of a word is one change, not two
FULL = 5  # expected occurrences of a symbol, from which on chi-squared goes by symbols
LEVEL = 0.01  # of the battery: the share of truly random strings that it may lose
CHANGES, RARE = 0.2, 0.12
EXACT = 512  # places up to which a binomial tail is summed; beyond, Chernoff's bound stands for it
BINS = 512  # of -ln p, up to 32; a p-value counts as the largest of its bin
STEP = 256  # matches whose places are added up at a time


def _let(fields: dict[str, Column], then) -> Column:
    """``then`` of a struct of ``fields``, each computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])), then)[0]


# --- spans -----------------------------------------------------------------------------------------------------


def running(numbers: Column) -> Column:
    """Running sums of an array of integers, STEP at a time, so that long arrays aren't copied for each element."""
    none = F.array().cast("array<int>")

    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / STEP).cast("int")), lambda i: within(F.slice(numbers, i * STEP + 1, STEP)))

    def joined(v: Column) -> Column:
        ends = within(F.transform(v["parts"], lambda p: p["at"]))["out"]
        return _let({"parts": v["parts"], "before": F.concat(F.array(F.lit(0)), ends)}, lambda w: F.flatten(F.zip_with(w["parts"], F.slice(w["before"], 1, F.size(w["parts"])), lambda p, b: F.transform(p["out"], lambda x: x + b))))

    return F.when(F.size(numbers) > 0, _let({"parts": parts}, joined)).otherwise(none)


def _spans(kind: str, parts: Column, matches: Column) -> Column:
    """Structs (kind, start, end, found) of matches, from the text's parts between them; positions in code points."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    steps = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda p, m: F.char_length(p) + F.char_length(m))
    made = F.zip_with(matches, running(steps), lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("found")))
    return F.when(F.size(matches) > 0, made).otherwise(none)


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """(row: all columns of ``docs``, base: known spans, those that fail their length dropped, tokens: candidates, tested)."""
    none = F.array().cast("array<string>")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lowered = F.lower("text")
    hints = F.lit(False)
    for h in ASSIGN_HINTS:
        hints = hints | F.contains(lowered, F.lit(h))
    for kind, pattern, gate in (
        ("random", CANDIDATE, F.lit(True)), ("hex", HEX, F.size("m_random") > 0), ("access", ACCESS, F.contains("text", F.lit("AKIA"))), ("assign", ASSIGN, hints),
    ):
        out = out.withColumn(f"m_{kind}", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        parts = F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1))
        out = out.withColumn(f"s_{kind}", _spans(kind, parts, F.col(f"m_{kind}")))
    long_enough = F.filter("s_assign", lambda s: F.char_length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)
    known = F.concat(long_enough, "s_access", "s_hex")
    out = out.withColumn("base", F.when(F.size(known) > 0, F.transform(F.array_sort(known, _by_place), _place)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    tokens = F.filter("s_random", lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]") & ~inside(s))
    judged = F.transform(tokens, lambda s: _let({"s": s, "b": battery(s["found"])}, lambda v: F.struct(
        v["s"]["start"].alias("start"), v["s"]["end"].alias("end"), v["b"]["stratum"].alias("stratum"), _bin(v["b"]).alias("bin"))))
    return out.select("row", "base", F.when(F.size("s_random") > 0, judged).otherwise(F.array().cast("array<struct<start:int,end:int,stratum:string,bin:int>>")).alias("tokens"))


def _place(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _by_place(a: Column, b: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    one = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    by_start, by_kind = one(a["start"], b["start"]), one(rank(a), rank(b))
    return F.when(by_start != 0, by_start).otherwise(by_kind)


# --- the battery -----------------------------------------------------------------------------------------------


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution; Zelen and Severo's polynomial, right to 7.5e-8, at least 1e-14."""

    def tail(v: Column) -> Column:
        t = 1 / (1 + 0.2316419 * F.abs(v["z"]))
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.struct(v["z"].alias("z"), (F.exp(-v["z"] * v["z"] / 2) * 0.3989422804014327 * poly).alias("tail"))

    return _let({"z": z}, lambda v: _let({"v": tail(v)}, lambda w: F.greatest(F.lit(1e-14), F.when(w["v"]["z"] >= 0, w["v"]["tail"]).otherwise(1 - w["v"]["tail"]))))


def _binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(at least k of n) if each comes with probability ``share``: summed up to EXACT, above that Chernoff's bound; at most 1."""
    odds = share / (1 - share)

    def summed(v: Column) -> Column:
        n, k = v["n"], v["k"]
        ways = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln((n - k + i) / i))
        start = F.struct(F.lit(0.0).alias("sum"), F.exp(ways + k * math.log(share) + (n - k) * math.log(1 - share)).alias("term"))
        return F.aggregate(F.sequence(k, n), start, lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (n - j) / (j + 1) * odds).alias("term")))["sum"]

    def bound(v: Column) -> Column:
        part = v["k"] / v["n"]
        rest = F.when(part < 1, (1 - part) * F.ln((1 - part) / (1 - share))).otherwise(0.0)
        return F.when(part <= share, F.lit(1.0)).otherwise(F.exp(-v["n"] * (part * F.ln(part / share) + rest)))

    return _let({"n": n, "k": k}, lambda v: F.least(F.lit(1.0), F.when(v["k"] <= 0, F.lit(1.0)).when(v["n"] <= EXACT, summed(v)).otherwise(bound(v))))


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, b: a + b)


def battery(token: Column) -> Column:
    """Struct (encoding, stratum, chi, runs, serial, p, changes, rare, ordinary) of a string of two or more key characters.

    chi, runs and serial are the tests' z-values and p their combination, all under the hypothesis that the string is
    uniformly random in its encoding; changes and rare are the two numbers, ordinary is their p-value under the
    hypothesis that the string is an ordinary one.
    """
    name = alphabet = F.lit(None).cast("string")
    for enc, pattern, letters in reversed(ENCODINGS):
        fits = token.rlike(pattern)
        name, alphabet = F.when(fits, F.lit(enc)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
    folded = lambda v: F.when(v["encoding"].isin("hex", "base36"), F.lower(v["token"])).otherwise(v["token"])
    return _let({"token": token, "encoding": name, "alphabet": alphabet}, lambda v: _let({"h": v, "folded": folded(v)}, _placed))


def _placed(v: Column) -> Column:
    h, token = v["h"], v["folded"]
    x = F.transform(F.split(token, ""), lambda c: F.instr(h["alphabet"], c).cast("double") - 1)
    times = lambda text, c: F.pow((F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))).cast("double"), F.lit(2.0))
    n, k = F.char_length(token).cast("double"), F.char_length(h["alphabet"]).cast("double")
    by_symbol = F.struct((_sum(F.transform(F.split(h["alphabet"], ""), lambda c: times(token, c))) * k / n - n).alias("chi2"), (k - 1).alias("df"))
    cells = F.array(*map(F.lit, ("[a-z]", "[A-Z]", "[^A-Za-z]")))
    shares = F.filter(F.transform(cells, lambda c: F.struct(F.regexp_count(token, c).cast("double").alias("o"), (n * F.regexp_count(h["alphabet"], c) / k).alias("e"))), lambda x: x["e"] > 0)
    by_cell = F.struct(_sum(F.transform(shares, lambda x: (x["o"] - x["e"]) * (x["o"] - x["e"]) / x["e"])).alias("chi2"), (F.size(shares) - 1).cast("double").alias("df"))
    squares = F.when(n >= FULL * k, by_symbol).otherwise(by_cell)
    words = F.regexp_replace(h["token"], "[^A-Za-z0-9]", "")
    fields = {"h": h, "x": x, "k": k, "squares": squares, "words": words}
    return _let(fields, lambda w: _measured(w))


def _measured(v: Column) -> Column:
    """Counts of the tests: chi-squared, runs, products of neighbours, changes and rare letters."""

    def then(w: Column) -> Column:
        x, high = v["x"], w["high"]
        first, second = (lambda a: F.slice(a, 1, F.size(a) - 1)), (lambda a: F.slice(a, 2, F.size(a) - 1))
        return _let({
            "n": w["n"], "n1": _sum(high), "squares": v["squares"],
            "runs": 1 + _sum(F.zip_with(first(high), second(high), lambda a, b: F.abs(a - b))),
            "spread": _sum(F.transform(x, lambda c: (c - w["middle"]) * (c - w["middle"]))),
            "together": _sum(F.zip_with(first(x), second(x), lambda a, b: (a - w["middle"]) * (b - w["middle"]))),
            "places": F.greatest(F.char_length(v["words"]) - 1, F.lit(0)), "changes": F.regexp_count(v["words"], F.lit(TURN)),
            "letters": F.regexp_count(v["words"], F.lit("[A-Za-z]")), "rare": F.regexp_count(v["words"], F.lit("[jkqvwxyzJKQVWXYZ]")),
        }, lambda m: _scored(v["h"], m))

    n = F.size(v["x"]).cast("double")
    return _let({"n": n, "middle": _sum(v["x"]) / n, "high": F.transform(v["x"], lambda c: (c >= v["k"] / 2).cast("double"))}, then)


def _scored(h: Column, m: Column) -> Column:
    """z-values and p-values; a symbol sequence without any spread is as far from random as can be."""
    n, df, both = m["n"], m["squares"]["df"], 2 * m["n1"] * (m["n"] - m["n1"])
    cube = F.pow(F.greatest(m["squares"]["chi2"], F.lit(0.0)) / df, F.lit(1 / 3))
    z = {
        "chi": (cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "runs": F.when(both > n, F.abs(m["runs"] - both / n - 1) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(8.0)),
        "serial": F.when(m["spread"] > 0, F.abs(m["together"] / m["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0)),
        "turns": _binomial_tail(m["places"], m["changes"], CHANGES),
        "odd": F.when(h["encoding"] == "hex", F.lit(None).cast("double")).otherwise(_binomial_tail(m["letters"], m["rare"], RARE)),  # hex has no such letters
    }

    def fisher(w: Column) -> Column:
        two_sided = lambda c: F.least(F.lit(1.0), 2 * _upper_tail(c))
        half = -(F.ln(_upper_tail(w["chi"])) + F.ln(two_sided(w["runs"])) + F.ln(two_sided(w["serial"])))
        pair = F.greatest(w["turns"] * w["odd"], F.lit(1e-60))
        ordinary = F.when(w["odd"].isNull(), w["turns"]).otherwise(F.least(F.lit(1.0), pair * (1 - F.ln(pair))))
        return _let({"half": half, "ordinary": ordinary}, lambda q: F.struct(
            h["encoding"].alias("encoding"), F.concat_ws(":", h["encoding"], F.floor(F.log2(n)).cast("string")).alias("stratum"),
            w["chi"].alias("chi"), w["runs"].alias("runs"), w["serial"].alias("serial"),
            (F.exp(-q["half"]) * (1 + q["half"] + q["half"] * q["half"] / 2)).alias("p"),
            m["changes"].alias("changes"), m["rare"].alias("rare"), q["ordinary"].alias("ordinary"),
        ))

    return _let(z, fisher)


def _bin(b: Column) -> Column:
    """The bin of -ln p of being ordinary; a string that the battery rejects has p = 1, bin 0."""
    return F.when(b["p"] >= LEVEL, F.least(F.lit(BINS - 1), F.floor(-F.ln(F.greatest(b["ordinary"], F.lit(1e-30))) * (BINS / 32.0)).cast("int"))).otherwise(F.lit(0))


def thresholds(found: DataFrame, rate: float = 0.05) -> dict[str, int]:
    """For each stratum of encoding and length the first bin of -ln p that is reported; strata that report nothing are absent.

    Benjamini-Hochberg over all candidates of the corpus (``tokens`` of ``found``); what comes to the driver is at most
    a number for each encoding and power of two in length.
    """
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("n"))
    as_counts = counts.groupBy("stratum").agg(F.collect_list(F.struct("bin", "n")).alias("bins"), F.sum("n").alias("m"))  # at most BINS each
    upto = F.aggregate(F.filter("bins", lambda b: b["bin"] >= F.col("edge")), F.lit(0).cast("long"), lambda a, b: a + b["n"])
    edges = as_counts.withColumn("edge", F.explode(F.transform("bins", lambda b: b["bin"]))).withColumn("reported", upto)
    passed = edges.where(F.exp(-F.col("edge") * (32.0 / BINS)) <= rate * F.col("reported") / F.col("m"))
    return {r["stratum"]: r["edge"] for r in passed.groupBy("stratum").agg(F.min("edge").alias("edge")).collect()}


def _with_spans(found: DataFrame, rate: float) -> DataFrame:
    """``found`` with spans in place of tokens: known ones and the reported random ones, by place."""
    first = thresholds(found, rate)
    if not first:
        return found.withColumn("spans", F.col("base")).drop("tokens")
    edge = F.create_map(*[F.lit(v) for kv in sorted(first.items()) for v in kv])
    reported = F.filter("tokens", lambda t: t["bin"] >= F.coalesce(F.try_element_at(edge, t["stratum"]), F.lit(BINS)))
    random = F.transform(reported, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    spans = F.when(F.size("tokens") > 0, F.array_sort(F.concat("base", random), _by_place)).otherwise(F.col("base"))
    return found.withColumn("spans", spans).drop("tokens")


# --- what users call -------------------------------------------------------------------------------------------


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def scan(docs: DataFrame, rate: float = 0.05, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns: ``base``, the known spans, and ``spans``, these and the random ones, as arrays of (kind, start, end).

    Sorted by start, then by kind in the order of KINDS; positions are code points, the end exclusive. Known kinds may
    overlap; a random span may reach beyond a known one but never lies inside it. Null texts count as empty and have
    none. All columns and rows stay, repeated or not; a new column whose name is taken gets underscores behind it. An
    empty table gives an empty result. Texts are read once, into the shared folder, as the thresholds need all candidates.
    """
    out = _with_spans(stored(_found(docs, text_col), "secrets"), rate)
    new = [_free(n, docs.columns) for n in ("base", "spans")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("base").alias(new[0]), F.col("spans").alias(new[1]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, numbers of each kind, the sha256 of the known spans, and all spans as text, for each row; see ``scan``. Only spans are written in between."""
    found = _found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text")
    spanned = _with_spans(stored(found.select(F.col("row.doc_id").alias("doc_id"), "base", "tokens"), "secrets"), rate)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spanned.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rate: float = 0.05, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs``, its columns and rows, with each run of overlapping spans of a text replaced by ``mark``; texts without spans, and null ones, stay as they are."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), joined).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    text = F.col(f"row.`{text_col}`")
    out = _with_spans(stored(_found(docs, text_col), "secrets"), rate).withColumn("runs", F.aggregate("spans", nothing, merge))
    before = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    after = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.char_length(text)))
    kept = F.zip_with(before, after, lambda a, b: F.substring(text, a + 1, b - a))
    blotted = F.when(F.size("runs") > 0, F.array_join(kept, mark)).otherwise(text)
    return out.select(*[(blotted if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
