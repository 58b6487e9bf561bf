"""Secret scan: fixed patterns plus a randomness test battery, in Spark expressions only.

Fixed patterns (``assign``, ``access``, ``hex``) give base spans. The battery adds
spans of kind ``random``: a candidate is a run of 20 or more characters of
``[A-Za-z0-9+/_-]`` (with up to two ``=``) that holds a digit and a letter and
overlaps no base span. Its encoding is inferred as the smallest alphabet that
holds it. Three tests of the hypothesis "independent uniform symbols" follow:
chi-squared over the alphabet (Wilson-Hilferty), runs above/below the alphabet's
middle (normal), lag-1 serial correlation of the symbols' quarters (normal).
Fisher's method joins the three p-values into one, ``p``.

False-discovery control, aware of length: truly random tokens have uniform ``p``,
others pile up near 0, the more the longer they are. So for each encoding and
length band (powers of two) the distinct tokens (by a 64-bit hash) with ``p >= 1/2`` tell the density of
random tokens, and the band's threshold is the lowest ``t`` of 0.05, 0.10, ...
at which the estimated share of others among tokens with ``p >= t`` is at most
``fdr``. The histogram of all distinct tokens (encodings x bands x 20 cells, a bounded
table) is all that reaches the driver. A band in which no token passes gets none.

Defined cases: null text counts as empty and has no spans; null or repeated
doc_ids stay one row each; of tokens that tie in the false-discovery order all or none are reported; very long texts are
scanned whole, one in one task (8,000 matches took 5 s there, more take over-proportionally longer); an empty table gives no rows; other columns pass through (base, spans,
candidates, _a, _k, _h and _c are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import table, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: a maximal run is taken or dropped whole, so the length can stand in the pattern
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
_D, _U = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_L = _U.lower()
#: encodings, smallest alphabet first: name, alphabet in code order
ENCODINGS = (("hex", _D + "abcdef"), ("hexu", _D + "ABCDEF"), ("base32", "234567" + _U), ("base36", _D + _L),
             ("base36u", _D + _U), ("base62", _D + _U + _L), ("base64", "+/" + _D + _U + _L), ("base64url", "-" + _D + _U + "_" + _L))
CELLS = 20
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,s:string>>"


def spans_of(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches, left to right, as (start, kind, end, s): ``s`` is the given group.

    The text between matches (split) and the matches (extract) alternate, so the
    running sum of their lengths is each match's place in code points.
    """
    rest, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(F.arrays_zip(found.alias("m"), shown.alias("s"), F.slice(rest, F.lit(1), F.size(found)).alias("r")), lambda x: x)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["r"])
        end = at + F.length(x["m"])
        one = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["s"].alias("s"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17), never 0."""
    x = F.least(F.abs(z), F.lit(8.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    up = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, up).otherwise(1 - up), F.lit(1e-15))


def _count(s: Column, x: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))) / len(x)


def _translate(s: Column, old: Column, new: Column) -> Column:
    return F.call_function("translate", s, old, new)


def _per_encoding(enc: Column, f) -> Column:
    """f(alphabet) of the encoding with index ``enc``."""
    return F.get(F.array(*[F.lit(f(alphabet)) for _, alphabet in ENCODINGS]), enc)


def _stages(tokens: Column) -> Column:
    """The array of candidates with ``p``, Fisher's joint p-value of the three tests.

    One transform after another, so that each intermediate value is computed once.
    """
    def coded(x: Column) -> Column:
        s, enc = F.rtrim(x["s"], F.lit("=")), x["enc"]
        alphabet = _per_encoding(enc, str)
        return F.struct(
            x.alias("x"), s.alias("s"), F.length(s).cast("double").alias("n"), alphabet.alias("alphabet"),
            F.length(alphabet).cast("double").alias("a"),
            _translate(s, alphabet, _per_encoding(enc, lambda t: "".join("01"[2 * i >= len(t)] for i in range(len(t))))).alias("bits"),
            _translate(s, alphabet, _per_encoding(enc, lambda t: "".join(str(4 * i // len(t)) for i in range(len(t))))).alias("q"))

    def counted(y: Column) -> Column:
        squares = F.aggregate(F.split(y["alphabet"], ""), F.lit(0.0),
                              lambda acc, c: acc + F.pow(y["n"] - F.length(F.replace(y["s"], c, F.lit(""))), F.lit(2)))
        return F.struct(
            y["x"].alias("x"), y["n"].alias("n"), (y["a"] - 1).alias("df"), (squares * y["a"] / y["n"] - y["n"]).alias("chi"),
            _count(y["bits"], "1").alias("ones"), (1 + _count(y["bits"], "01") + _count(y["bits"], "10")).alias("runs"),
            F.array(*[_count(y["q"], str(i)) for i in range(4)]).alias("c"),
            F.array(*[F.array(*[_count(y["q"], f"{i}{j}") if i != j else F.lit(0.0) for j in range(4)]) for i in range(4)]).alias("pair"),
            F.left(y["q"], F.lit(1)).cast("int").alias("first"), F.right(y["q"], F.lit(1)).cast("int").alias("last"))

    def summed(y: Column) -> Column:
        c, pair = y["c"], y["pair"]
        # equal neighbours of a value: its symbols less its runs
        products = sum((i * j * pair[i][j] for i in range(1, 4) for j in range(1, 4) if i != j), F.lit(0.0)) + sum(
            (i * i * (c[i] - sum((pair[j][i] for j in range(4) if j != i), F.when(y["first"] == i, 1.0).otherwise(0.0))) for i in range(1, 4)), F.lit(0.0))
        zeros = y["n"] - y["ones"]
        return F.struct(
            *[y[k].alias(k) for k in ("x", "n", "df", "chi", "runs", "first", "last")],
            (2 * y["ones"] * zeros / y["n"]).alias("mu"), products.alias("products"),
            (sum((i * c[i] for i in range(1, 4)), F.lit(0.0)) / y["n"]).alias("m"),
            sum((i * i * c[i] for i in range(1, 4)), F.lit(0.0)).alias("raw"))

    def scored(y: Column) -> Column:
        n, m, mu, df = y["n"], y["m"], y["mu"], y["df"]
        return F.struct(
            y["x"].alias("x"), n.alias("n"),
            ((F.pow(F.greatest(y["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("z_chi"),
            F.abs(y["runs"] - 1 - mu).alias("off"), (mu * (mu - 1) / (n - 1)).alias("var"),
            (y["products"] - m * (2 * n * m - y["first"] - y["last"]) + (n - 1) * m * m).alias("cov"), (y["raw"] - n * m * m).alias("ss"))

    def tails(y: Column) -> Column:
        runs = F.when(y["var"] > 0, F.least(F.lit(1.0), 2 * _tail(y["off"] / F.sqrt(y["var"])))).otherwise(1e-15)
        serial = F.when(y["ss"] > 0, F.least(F.lit(1.0), 2 * _tail(F.abs(y["cov"] / y["ss"] + 1 / y["n"]) * F.sqrt(y["n"])))).otherwise(1e-15)
        return F.struct(y["x"].alias("x"), y["n"].alias("n"), (-(F.log(_tail(y["z_chi"])) + F.log(runs) + F.log(serial))).alias("h"))

    def joined(y: Column) -> Column:
        x, h = y["x"], y["h"]
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["enc"].alias("enc"),
                        F.floor(F.log2(y["n"])).cast("int").alias("band"), (F.exp(-h) * (1 + h + h * h / 2)).alias("p"),
                        F.xxhash64(F.rtrim(x["s"], F.lit("="))).alias("token"))

    for f in (coded, counted, summed, scored, tails, joined):
        tokens = F.transform(tokens, f)
    return tokens


def _encoding(token: Column) -> Column:
    """Index of the inferred encoding; null without a digit and a letter."""
    s, out = F.rtrim(token, F.lit("=")), F.lit(None).cast("int")
    for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(F.translate(s, alphabet, "") == "", F.lit(i)).otherwise(out)
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]"), out)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (base spans by start, then kind) and ``candidates``
    (place, encoding, length band, p, hash). One narrow pass over the texts."""
    docs = docs.drop("base", "candidates", "spans", "_a", "_k", "_h", "_c")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_a", spans_of(text, ASSIGN, 0, 2)).withColumn("_k", spans_of(text, ACCESS, 1)) \
        .withColumn("_h", spans_of(text, HEX, 2)).withColumn("_c", spans_of(text, CANDIDATE, 3))
    df = df.withColumn("base", F.array_sort(F.transform(
        F.concat(F.filter("_a", lambda x: F.length(x["s"]) >= 8), F.col("_k"), F.col("_h")),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
    free = F.filter("_c", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    known = F.filter(F.transform(free, lambda x: F.struct(x["start"], x["kind"], x["end"], x["s"], _encoding(x["s"]).alias("enc"))),
                     lambda x: x["enc"].isNotNull())
    df = df.withColumn("_c", F.when(F.size("_c") > 0, known))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,enc:int,band:int,p:double,token:bigint>>")
    return df.withColumn("candidates", F.when(F.size("_c") > 0, _stages(F.col("_c"))).otherwise(none)).drop("_a", "_k", "_h", "_c")


def thresholds(scanned: DataFrame, fdr: float = 0.1) -> dict[tuple[int, int], float]:
    """Per (encoding, length band) the lowest p that keeps the false-discovery rate."""
    cell = F.least(F.floor(F.col("c.p") * CELLS), F.lit(CELLS - 1)).cast("int")
    # a repeated token is one test, however many copies it has; copies are combined before the shuffle
    tokens = scanned.select(F.explode("candidates").alias("c")).select("c.enc", "c.band", cell.alias("cell"), "c.token").distinct()
    rows = tokens.groupBy("enc", "band", "cell").count().collect()
    hist: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        hist.setdefault((r["enc"], r["band"]), [0] * CELLS)[r["cell"]] = r["count"]
    out = {}
    for key, h in hist.items():
        density = sum(h[CELLS // 2:]) / (CELLS - CELLS // 2)
        for t in range(1, CELLS):
            n = sum(h[t:])
            if n and 1 - density * (CELLS - t) / n <= fdr:
                out[key] = t / CELLS
                break
    return out


def decide(scanned: DataFrame, limits: dict[tuple[int, int], float]) -> DataFrame:
    """``scanned`` with ``spans``: base spans and accepted candidates, by start, then kind."""
    def ok(x: Column) -> Column:
        passed = F.lit(False)
        for (enc, band), t in sorted(limits.items()):
            passed = passed | ((x["enc"] == enc) & (x["band"] == band) & (x["p"] >= t))
        return passed

    more = F.transform(F.filter("candidates", ok), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", more))).drop("candidates")


def shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``text`` with each maximal stretch covered by ``spans`` replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.lit(mark))).alias("out"))
        more = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((x["start"] < acc["at"]) & (acc["at"] > 0), more).otherwise(fresh)

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), (acc["at"] + 1).cast("int")))

    return df.withColumn("text", F.when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(F.col("text")))


def find_secrets(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """``docs`` with ``base`` and ``spans``; the texts are scanned once, their spans
    stored in the shared folder, and thresholds come from all candidates."""
    found = written(scan(docs), "secrets")
    return decide(found, thresholds(found, fdr))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text is needed by the scan only: what is stored is one row of spans per document
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(scan(docs).drop("text"), "secrets")
    out = decide(found, thresholds(found))
    def count(kind: int) -> Column:  # a second parameter of the lambda, even one with a default, would be the element's place
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    n = [count(i) for i in range(3)]
    return out.select("doc_id", n[0].alias("n_assign"), n[1].alias("n_access"), n[2].alias("n_hex"),
                      F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
