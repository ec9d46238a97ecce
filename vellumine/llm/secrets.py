"""Secret scans in SQL expressions alone: fixed formats, and a battery of randomness tests over other long tokens.

Fixed formats are found leftmost and without overlap, each kind by itself: a key word with an assigned
value (`assign`), access key identifiers (`access`) and runs of hexadecimal digits (`hex`).

Other tokens of LEAST characters or more are tested. Their encoding is inferred from their characters,
which become numbers from 0 to k-1. Three tests ask whether these are uniform draws: chi-squared over the
alphabet, runs above and below its middle, and serial correlation at lag 1. Three times the least of their p-values is the
battery's. Within each class of lengths (powers of two), over all documents, the Benjamini-Hochberg bound at FALSE_REJECTIONS on
these p-values tells which tokens are not random. The rest must also differ from ordinary writing: the
likelihood of a token under a fixed model of written ones (which kind of character follows which, and which
letter which) is divided by that of uniform draws. If the token is written, this quotient is p or less with a
probability of at most p (Markov), whatever the length, and for random ones it falls exponentially with length.
Digits alone have no such model; their chance that a pair agrees is compared with that of written numbers, with
a deviation that shrinks with length. These p-values are held against the Benjamini-Hochberg bound at
FALSE_DISCOVERIES within each class of lengths, so short tokens, of which many are looked at and little is known, don't use up what
long ones allow. Both bounds come from a histogram whose size is bounded whatever the data.

Work grows in proportion to a text's length and, up to a logarithm, to its spans. Null text counts as empty and has no spans. Rows are
judged one by one, repeated ones alike; ids play no part, and no rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, checkpointed, guarded, written

LEAST = 20
#: Shares of false ones among the tokens that the battery calls not random, and among those that are then called random.
FALSE_REJECTIONS, FALSE_DISCOVERIES = 0.001, 0.01
#: Classes of lengths; p-values are counted by their logarithm, down to 10**-8 for the battery and 10**-20 against writing.
CLASSES, BINS_A_DECADE, BATTERY_BINS, BINS = 16, 20, 160, 400
#: Characters of a token, and of a text, that are looked at together.
FOLD, CHUNK = 256, 1024

#: The kinds in their order, each with its pattern and the least length of the match or of its value.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, narrowest first: name, pattern of the body, and alphabet.
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIGIT),
    ("hex", "^[0-9a-f]+$", _DIGIT + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGIT + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", _DIGIT + _LOWER),
    ("upper36", "^[A-Z0-9]+$", _DIGIT + _UPPER),
    ("alnum62", "^[A-Za-z0-9]+$", _DIGIT + _UPPER + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGIT + "-_"),
    ("other66", "^.*$", _UPPER + _LOWER + _DIGIT + "-_+/"),
]
#: In written numbers, the chance that two digits agree, and that three do.
KAPPA, KAPPA3 = 0.16, 0.030
#: Kinds of characters (lower case, upper case, digit, sign) in written tokens: the first one, and which follows each.
_KINDS = [(0.50, 0.25, 0.20, 0.05), (0.90, 0.04, 0.03, 0.03), (0.32, 0.60, 0.04, 0.04), (0.06, 0.06, 0.80, 0.08), (0.50, 0.25, 0.20, 0.05)]
#: Letters in written words: the first one, then those after a, b, c, ..., 26 each; bits in quarters, rounded down, from "0". Counted in texts in
#: ten languages with Latin letters (licences and manuals in English, translated messages in the others), English for one half; 5 % go to all letters alike.
_LETTERS = (
    "@A?CCCCFBLNA@=B>OBB;FFDIMSMHDBOL?O@SI=>9OIS>?:JINQJS@NLN;QRS;DR=ISBPTAJM6RSSBS@QKR;RS:DSDDIR6PSHL<BOSTOK<JO=9NMS7QSKQO>NT=FP@PRRMK"
    "?K@?FFMQLOQAF;PAN9<@RDM@NS@QPP9BST9TTGPR7ST>D@FTSTJTGQOS7NGD9TSKH@INT@:P<SQTPT8SSR4SST@HTRQP>NTDLEGTSTQTEHB>DFFTRNPAB9:KRI<;SITJTL"
    "?RBR3TPPPTAQSP;IKS>MBSQPTS8RSF8IGR;TKOPF;ITP>EGTMTOT7MRD;NST;TO=KS=MTPBE>PQTBT9HRO8SSS=TSM?P?ASL8QFRSTSTDL@>>I:SENLIMF@ESP;9@LSSIT"
    "JICBGCDOKELF@7IFT7FAAHFRSO>RNH=RQEETO9LR9ET9KBDSSSBTTTTTRTTTTTTKTTTQTTLA0TTNTT:PEJ8NAS@TGJCH<NPC>@IJPSFNFRFR:E=B<SL@MQAFQI?8CJMSKO"
    "BSIR8FS:=RRLQS;HT:DCJTMSDS<DDIBJ<TFTSA@?PBM:><SSTMTM>SOS2TRT9TSTSMATTHLSSSTSST>SSS7SS<7SGORI?STF>GSTOGKTDSBL:RTN@TTTFNQ>TPO3OSLNKS"
    "AOFPFQOSCTMHEG94RD?BRSKTQJ?TNT3RTP:T@J@LIRTPIROTTTDG"
)


def _coded(p: float) -> str:
    return chr(48 + min(43, math.floor(-4 * math.log2(p))))


def _model(alphabet: str) -> tuple[str, float, float, float]:
    """The model within an alphabet: bits of the kinds (as _LETTERS), then bits of a letter (0: by _LETTERS), digit and sign."""
    digits, letters = sum(c in _DIGIT for c in alphabet), {c for c in alphabet.lower() if c in _LOWER}
    kinds = [any(c in of for c in alphabet) for of in (_LOWER, _UPPER, _DIGIT, "-_+/")]
    shares = [[p * k for p, k in zip(row, kinds, strict=True)] for row in _KINDS]
    bits = "".join(_coded(p / sum(row)) if p else "[" for row in shares for p in row)
    return bits, math.log2(len(letters)) if len(letters) < 26 and letters else 0.0, math.log2(max(digits, 1)), math.log2(max(sum(c in "-_+/" for c in alphabet), 1))


_SPAN = "struct<s:bigint,k:int,e:bigint,v:string,g:string>"


def _let(name: str, value: str, body: str) -> str:
    """The body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, both: Callable[[str, str], str]) -> str:
    """Running totals of an array by doubling: n log n steps, and no array grows."""
    step = both("y", "acc[i - shiftleft(1, d)]")
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({values}), 1))) as int)), {values}, (acc, d) -> transform(acc, (y, i) -> CASE WHEN i >= shiftleft(1, d) THEN {step} ELSE y END))"


def _found(text: str, pattern: str, group: int, kind: int) -> Column:
    """array<struct<s, k, e, v, g>> of all matches of a pattern in a text column: places in code points, the match and the group.

    Splitting at the matches gives what lies between them, from whose lengths the places follow.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    widths = "transform(x.m, (v, i) -> cast(length(v) + length(x.gaps[i]) as bigint))"
    spans = f"transform(x.m, (v, i) -> named_struct('s', ends[i] - length(v), 'k', {kind}, 'e', ends[i], 'v', v, 'g', x.g[i]))"
    matches = f"named_struct('m', regexp_extract_all({text}, '{quoted}', 0), 'g', regexp_extract_all({text}, '{quoted}', {group}), 'gaps', split({text}, '{quoted}', -1))"
    return F.expr(f"""
        CASE WHEN {text} RLIKE '{quoted}' THEN {_let("x", matches, _let("w", widths, _let("ends", _scan("w", lambda a, b: f"{a} + {b}"), spans)))}
        ELSE cast(array() as array<{_SPAN}>) END""")


def _meets(spans: str, c: str) -> str:
    """Whether one of the spans, which ascend and don't overlap, overlaps c: the last one that begins before c's end decides."""
    before = f"aggregate(sequence(cast(floor(log2(greatest(size({spans}), 1))) as int), 0), 0, (a, d) -> CASE WHEN a + shiftleft(1, d) <= size({spans}) AND {spans}[a + shiftleft(1, d) - 1].s < {c}.e THEN a + shiftleft(1, d) ELSE a END)"
    return f"(size({spans}) > 0 AND {_let('n', before, f'n > 0 AND {spans}[greatest(n, 1) - 1].e > {c}.s')})"


def _upper_tail(z: str) -> str:
    """P(Z > z) for z >= 0, to about 7 places (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419D * ({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"(exp(-least(({z}) * ({z}), 1400D) / 2) * 0.3989422804014327D * {poly})"


def _tail(z: str) -> str:
    return f"(CASE WHEN ({z}) >= 0 THEN {_upper_tail(z)} ELSE 1 - {_upper_tail(f'-({z})')} END)"


def _by_encoding(body: str, value: Callable[[tuple[str, str, str]], str]) -> str:
    return "CASE " + " ".join(f"WHEN {body} RLIKE '{e[1]}' THEN {value(e)}" for e in ENCODINGS[:-1]) + f" ELSE {value(ENCODINGS[-1])} END"


def _bin(p: str, most: int) -> str:
    return f"cast(least({most}D, floor(-log10(greatest({p}, 1e-300)) * {BINS_A_DECADE})) as int)"


def _tested(spans: str) -> Column:
    """Candidates with the battery's results: encoding, chi2, runs_z, serial_z, class of lengths, and the bins of both p-values."""
    body = "rtrim('=', c.v)"
    model = lambda e: "named_struct('kinds', '{}', 'letter', {}D, 'digit', {}D, 'sign', {}D)".format(*_model(e[2]))
    # Of a character: its number less their mean, its kind (0 to 3), and its place among the letters (1 to 26).
    facts = f"""named_struct('x', instr(c.abc, y) - 1 - (c.k - 1) / 2, 'l', instr('{_LOWER}', lower(y)),
                'k', CASE WHEN instr('{_LOWER}', y) > 0 THEN 0 WHEN instr('{_UPPER}', y) > 0 THEN 1 WHEN instr('{_DIGIT}', y) > 0 THEN 2 ELSE 3 END)"""
    then = f"""named_struct('serial', a.serial + a.x * y.x, 'x', y.x, 'b', a.b + (ascii(substring(c.m.kinds, 4 * (a.k + 1) + y.k + 1, 1)) - 48) / 4D
                + CASE WHEN y.k = 2 THEN c.m.digit WHEN y.k = 3 THEN c.m.sign WHEN c.m.letter > 0 THEN c.m.letter ELSE (ascii(substring('{_LETTERS}', 26 * a.l + y.l, 1)) - 48) / 4D END,
                'l', y.l, 'k', y.k)"""
    steps = [
        f"""transform({spans}, c -> named_struct('s', c.s, 'e', c.e, 'body', {body}, 'enc', {_by_encoding(body, lambda e: f"'{e[0]}'")},
             'abc', {_by_encoding(body, lambda e: f"'{e[2]}'")}, 'm', {_by_encoding(body, model)}, 'k', {_by_encoding(body, lambda e: f"{len(e[2])}D")}))""",
        # Counts by removal, runs by changes between the halves of the alphabet; what looks at neighbours goes through FOLD characters at a time.
        f"""transform({{x}}, c -> named_struct('s', c.s, 'e', c.e, 'enc', c.enc, 'n', cast(length(c.body) as double), 'k', c.k,
             'sq', aggregate(sequence(1, length(c.abc)), 0D, (a, i) -> a + power(cast(length(c.body) - length(replace(c.body, substring(c.abc, i, 1), '')) as double), 2)),
             'runs', {_let("h", "translate(c.body, c.abc, concat(repeat('0', length(c.abc) div 2), repeat('1', length(c.abc) div 2)))", "1D + length(h) - (length(replace(h, '01', '')) + length(replace(h, '10', ''))) / 2D")},
             'of', aggregate(regexp_extract_all(c.body, '.{{{{1,{FOLD}}}}}', 0), named_struct('serial', 0D, 'x', 0D, 'b', 0D, 'l', 0, 'k', -1),
               (st, part) -> aggregate(transform(regexp_extract_all(part, '.', 0), y -> {facts}), st, (a, y) -> {then}))))""",
        # Moments under uniform draws; under written numbers, of the share of agreeing pairs.
        f"""transform({{x}}, c -> named_struct('s', c.s, 'e', c.e, 'enc', c.enc, 'n', c.n,
             'chi2', c.k / c.n * c.sq - c.n,
             'chi2_z', (c.k / c.n * c.sq - c.n - (c.k - 1)) / sqrt(2 * (c.k - 1) * (1 - 1 / c.n)),
             'runs_z', (c.runs - 1 - (c.n - 1) / 2) / (sqrt(c.n - 1) / 2),
             'serial_z', c.of.serial / ((c.k * c.k - 1) / 12) / sqrt(c.n - 1),
             'quotient', exp(least(0D, (c.n * log2(c.k) - c.of.b) * {math.log(2)!r}D)),
             'natural_z', ((c.sq - c.n) / (c.n * (c.n - 1)) - {KAPPA}D) / sqrt((2 * {KAPPA - KAPPA * KAPPA!r}D + 4 * (c.n - 2) * {KAPPA3 - KAPPA * KAPPA!r}D) / (c.n * (c.n - 1)))))""",
        f"""transform({{x}}, c -> named_struct('s', c.s, 'e', c.e, 'enc', c.enc, 'chi2', c.chi2, 'runs_z', c.runs_z, 'serial_z', c.serial_z, 'class', cast(least({CLASSES - 1}, floor(log2(c.n))) as int),
             'battery', {_bin(f'least(1D, 3 * least({_tail("c.chi2_z")}, 2 * {_upper_tail("abs(c.runs_z)")}, 2 * {_upper_tail("abs(c.serial_z)")}))', BATTERY_BINS)},
             'written', {_bin(f"CASE WHEN c.enc = 'decimal' THEN {_tail('-c.natural_z')} ELSE c.quotient END", BINS)}))""",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = step.replace("{x}", out).replace("{{", "{").replace("}}", "}")
    return F.expr(out)


def examine(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `_base` and `_tested`: spans of the fixed formats, and tested tokens that overlap none of them."""
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for i, (name, pattern, group, least) in enumerate(KINDS):
        df = df.withColumn(f"_{name}", _found("_t", pattern, group, i)).withColumn(f"_{name}", F.expr(f"transform(filter(_{name}, x -> length(x.g) >= {least}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"))
    df = df.withColumn("_candidates", _found("_t", CANDIDATE, 0, len(KINDS)))
    df = df.withColumn("_candidates", F.expr("filter(_candidates, c -> NOT (" + " OR ".join(_meets(f"_{name}", "c") for name, *_ in KINDS) + "))"))
    df = df.withColumn("_tested", _tested("_candidates")).withColumn("_base", F.array_sort(F.concat(*(f"_{name}" for name, *_ in KINDS))))
    return df.drop("_t", "_candidates", *(f"_{name}" for name, *_ in KINDS))


def _least_bin(counts: DataFrame, bin_: str, share: float) -> DataFrame:
    """(class, bin): by Benjamini-Hochberg, the first bin of small p-values that are discoveries. Edges count as their bin's p-value, so it errs on the safe side."""
    own = counts.groupBy("class", F.col(bin_).alias("bin")).agg(F.sum("n").alias("n"))
    found = F.sum("n").over(Window.partitionBy("class").orderBy(F.col("bin").desc()))
    edge = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_A_DECADE)))
    ranked = own.withColumn("found", found).withColumn("all", F.sum("n").over(Window.partitionBy("class")))
    return ranked.where((F.col("bin") > 0) & (edge * F.col("all") <= share * F.col("found"))).groupBy("class").agg(F.min("bin").alias("bin"))


def bounds(examined: DataFrame) -> list[tuple[int, int, int]]:
    """(class, battery bin, written bin) of each class of lengths: from these on a token is not random, and not written. CLASSES at most."""
    # One number for all three, so that a token's tests aren't planned again for each field.
    code = examined.select(F.explode(F.expr("transform(_tested, c -> (c.class * 512 + c.battery) * 512 + c.written)")).alias("code"))
    field = lambda x, name: x.cast("int").alias(name)
    counts = code.groupBy("code").agg(F.count("*").alias("n")).select(field(F.shiftright("code", 18), "class"), field(F.shiftright("code", 9) % 512, "battery"), field(F.col("code") % 512, "written"), "n")
    counts = checkpointed(counts)  # bounded by the numbers of bins
    never = F.lit(BINS + 1)
    rejected = counts.join(_least_bin(counts, "battery", FALSE_REJECTIONS).withColumnRenamed("bin", "reject"), "class", "left").withColumn("reject", F.coalesce("reject", never))
    # Tokens that the battery rejects are tests as well, but can't be discoveries.
    rest = _least_bin(rejected.withColumn("written", F.when(F.col("battery") < F.col("reject"), F.col("written")).otherwise(0)), "written", FALSE_DISCOVERIES)
    return [tuple(r) for r in rejected.select("class", "reject").distinct().join(rest, "class").select("class", "reject", "bin").collect()]


def judged(examined: DataFrame, limits: list[tuple[int, int, int]]) -> DataFrame:
    """The examined rows with `base_spans` and `all_spans`, arrays of (s, k, e) by place and kind; k = 3 marks the battery's."""
    random = " OR ".join(f"(c.class = {c} AND c.battery < {a} AND c.written >= {b})" for c, a, b in limits) or "false"
    found = F.expr(f"transform(filter(_tested, c -> {random}), c -> named_struct('s', c.s, 'k', {len(KINDS)}, 'e', c.e))")
    return examined.withColumn("base_spans", F.col("_base")).withColumn("all_spans", F.array_sort(F.concat("_base", found))).drop("_base", "_tested")


_NAMES = [name for name, *_ in KINDS] + ["random"]


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{n}'" for n in _NAMES)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row.

    What was examined, without the texts, is written once to the shared folder, as the bounds come from all of it.
    """
    seen = written(examine(docs.select(docs[key].alias("k"), docs[text].alias("t")), "t").drop("t"), f"{checkpoint_dir(docs.sparkSession)}/examined")
    found = judged(seen, bounds(seen))
    counts = [F.expr(f"size(filter(base_spans, x -> x.k = {i}))").cast("long").alias(f"n_{name}") for i, name in enumerate(_NAMES[:-1])]
    return found.select(F.col("k").alias(key), *counts, F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"), (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_random"))


def _cut(text: str) -> Column:
    """The text with a mark for each group of overlapping spans, put together from pieces of chunks, so that no piece is looked for from the text's start."""
    names = ", ".join(f"'{n}'" for n in _NAMES)

    def piece(a: str, b: str) -> str:
        part = f"substring(chunks[q], cast(greatest({a} - q * {CHUNK}, 0) + 1 as int), cast(least({b} - q * {CHUNK}, {CHUNK}) - greatest({a} - q * {CHUNK}, 0) as int))"
        return f"CASE WHEN {a} >= {b} THEN '' ELSE array_join(transform(sequence({a} div {CHUNK}, ({b} - 1) div {CHUNK}), q -> {part}), '') END"

    ends = _scan("e", lambda a, b: f"greatest({a}, {b})")
    heads = "filter(transform(all_spans, (x, i) -> named_struct('s', x.s, 'k', x.k, 'at', CASE WHEN i = 0 THEN 0L ELSE ends[i - 1] END)), x -> x.s >= x.at)"
    marked = f"array_join(transform({heads}, h -> concat({piece('h.at', 'h.s')}, '[REDACTED:', element_at(array({names}), h.k + 1), ']')), '')"
    whole = f"concat({marked}, {_let('z', 'element_at(ends, -1)', _let('n', f'cast(length({text}) as bigint)', piece('z', 'n')))})"
    return F.expr(f"""CASE WHEN size(all_spans) = 0 THEN {text} ELSE
        {_let("chunks", f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)", _let("e", "transform(all_spans, x -> x.e)", _let("ends", ends, whole)))} END""")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, each span of their text replaced by `[REDACTED:kind]`; overlapping spans give one mark. Null text stays null.

    Texts are examined twice, for the bounds and for the marks, and written nowhere.
    """
    limits = bounds(examine(docs.select(docs[text].alias("t")), "t"))
    inside, restored = guarded(docs, [text])
    return restored(judged(examine(inside, text), limits).withColumn(text, _cut(text)))
