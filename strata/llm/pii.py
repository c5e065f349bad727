"""Personal data, found by patterns and by what the corpus reveals, with DataFrame functions only.

*Base spans.* Four kinds are matched by Java regular expressions, leftmost and non-overlapping per kind: email,
ip (parts at most 255), card (14 to 19 digits that pass Luhn) and phone (10 to 15
digits). The patterns are possessive and begin only where a run begins, so they
take linear time on any text. A match's place is the sum of the lengths of what
a split by the same pattern leaves before it, in code points.

*Disclosing terms.* Each base value is a protected entity e; a word of ``least_letters`` letters or more is a term t.
Over all rows of the corpus are counted n(t, e): rows that hold both, wherever they stand, n(e)
and n(t): rows with e, and with t. The information that t gives about e is
PMI(t; e) = ln(N n(t,e) / (n(t) n(e))); at most it is all of e's own information IC(e) = ln(N / n(e)).
A term whose PMI is at least ``disclosure`` of IC(e) for any e
reveals it: it becomes a span of kind ``term`` at every place outside base spans, in every row of the corpus. No value is too rare
for this: one that stands in a single row is revealed by the words of that row that hardly stand elsewhere. (``support`` asks for more rows of a pair;
its default of 1 leaves nothing out.)
Spans of full disclosure (PMI = IC(e)) are removed by ``sanitize``, others are generalised.

That is ``window=None``, which the query and ``sanitize`` take. With a number, only words in so many characters around a
value are its terms, and they become spans only there.

Values that stand in the same texts share a class, and so do words; pairs are formed between classes, and only where the counts of both still
allow the least PMI. All counts are aggregated within tasks before they are shuffled, and a word's rows are joined in several tasks, so neither
a value nor a word that stands in every row gathers in one task. Nothing that grows with the corpus is broadcast by hand; a bitmap of fixed size
tells which words may be revealing before their places are worked out.

Defined results: a null text is the empty text and has no spans. Repeated rows
come back as often as they came, each with its own spans. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Kinds in the order of the spans' listing; a rank is the place here.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"\p{L}[\p{L}\p{M}]*+"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Up to 32 words with what stands before them; or the rest behind the last word.
PIECE = r"(?:\P{L}*+\p{L}[\p{L}\p{M}]*+){1,32}+|\P{L}++"
_RUN = 256
#: Tasks that share the rows of one key in a join.
_SALT = 16
#: Slots of 64 bits in the bitmap of revealing words.
_SLOTS = 1 << 16


def _upto(lengths: Column) -> tuple[Column, Column]:
    """(sums of whole runs, a function's input) for prefix sums in about n * n / 512 steps instead of n * n / 2."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _RUN).cast("int")), lambda k: total(F.slice(lengths, 1, k * _RUN)))
    return runs, lengths


def _prefix(runs: Column, lengths: Column, n: Column) -> Column:
    """Sum of the first n lengths."""
    whole = F.floor(n / _RUN).cast("int")
    rest = F.slice(lengths, whole * _RUN + 1, n - whole * _RUN)
    return F.get(runs, whole) + F.aggregate(rest, F.lit(0), lambda s, x: s + x)


def _matches(df: DataFrame, text: str, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds `name`: array of (start, end, value), every match of the pattern."""
    df = df.withColumn("__m", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), 0)))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)))
    lengths = F.zip_with("__m", F.slice("__g", 1, F.size("__m")), lambda m, g: F.length(m) + F.length(g))
    df = df.withColumn("__l", F.when(F.size("__m") > 0, lengths))
    runs, own = _upto(F.col("__l"))
    df = df.withColumn("__r", F.when(F.size("__m") > 0, runs))

    def place(m: Column, i: Column) -> Column:
        stop = _prefix(F.col("__r"), own, i + 1)
        return F.struct((stop - F.length(m)).cast("int").alias("start"), stop.cast("int").alias("end"), m.alias("value"))

    found = F.when(F.size("__m") > 0, F.transform("__m", place))
    return df.withColumn(name, found).drop("__m", "__g", "__l", "__r")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _ranked(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value"))


def _identity(text: Column) -> list[Column]:
    """th and th2: 128 bits that stand for a text where its spans come back to it."""
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit("second"), text).alias("th2")]


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, th and th2 (two hashes of the text), base: array of (start, rank, end, value), in order."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    df = _matches(df, "text", "email", EMAIL, F.contains("text", F.lit("@")))
    df = _matches(df, "text", "ip", IP, F.lit(True))
    df = _matches(df, "text", "card", CARD, F.lit(True))
    df = _matches(df, "text", "phone", PHONE, F.contains("text", F.lit("+")))
    between = lambda v, low, high: (F.length(_digits(v)) >= low) & (F.length(_digits(v)) <= high)
    valid = {
        "ip": lambda x: x["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": lambda x: between(x["value"], 14, 19) & _luhn(_digits(x["value"])),
        "phone": lambda x: between(x["value"], 10, 15),
    }
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    lists = []
    for rank, kind in enumerate(KINDS[:4]):
        own = F.filter(kind, valid[kind]) if kind in valid else F.col(kind)
        lists.append(F.coalesce(F.transform(own, _ranked(rank)), none))
    return df.select("id", "text", *_identity(F.col("text")), F.array_sort(F.concat(*lists)).alias("base"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _terms_beside(text: Column, span: Column, window: int, least_letters: int, base: Column) -> Column:
    """Array of (term, start, end): whole words of one span's surroundings, outside all base spans."""
    low = F.greatest(span["start"] - window, F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    letter = lambda at: F.substring(text, at, F.lit(1)).rlike(r"[\p{L}\p{M}]")

    def side(begin: Column, size: Column) -> Column:
        part = F.substring(text, begin + 1, size)
        cut = F.struct(F.regexp_extract_all(part, F.lit(TERM), 0).alias("words"), F.split(part, TERM, -1).alias("gaps"))

        def places(own: Column) -> Column:
            def placed(w: Column, i: Column) -> Column:
                start = begin + total(F.slice(own["gaps"], 1, i + 1)) + total(F.slice(own["words"], 1, i))
                return F.struct(F.lower(w).alias("term"), start.cast("int").alias("start"), (start + F.length(w)).cast("int").alias("end"))

            return F.filter(F.transform(own["words"], placed), lambda w: w["end"] - w["start"] >= least_letters)

        return _let(cut, places)

    def whole(w: Column, near: Column) -> Column:
        """Not cut by the window, and apart from every base span."""
        cut = ((w["start"] == low) & (low > 0) & letter(w["start"])) | ((w["end"] == span["end"] + window) & letter(w["end"] + 1))
        return ~cut & F.forall(near, lambda b: (b["end"] <= w["start"]) | (b["start"] >= w["end"]))

    words = F.concat(side(low, span["start"] - low), side(span["end"], F.lit(window)))
    close = F.filter(base, lambda b: (b["end"] > low) & (b["start"] < span["end"] + window))
    return _let(close, lambda near: F.filter(words, lambda w: whole(w, near)))


def _word(least_letters: int) -> str:
    """Matches whole words of so many letters."""
    return rf"\p{{L}}[\p{{L}}\p{{M}}]{{{max(least_letters - 1, 0)},}}+"


def _words(text: Column, least_letters: int) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_word(least_letters)), 0), lambda w: F.lower(w)))


def _entity(span: Column) -> Column:
    return F.concat(span["rank"].cast("string"), F.lit(":"), F.lower(span["value"]))


def _row_counts(docs: DataFrame, text_col: str, least_letters: int) -> DataFrame:
    """term, n_t: rows that hold it."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.explode(_words(text, least_letters)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def _pmi(n: float, n_te: Column) -> Column:
    return F.log(F.lit(n) * n_te / (F.col("n_t") * F.col("n_e")))


def _own(n: float) -> Column:
    return F.log(F.lit(n) / F.col("n_e"))


def _spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join where the rows of one key in `many` go to several tasks; `few` is repeated."""
    many = many.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALT)).cast("int"))
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    return many.join(few, [*keys, "__salt"], how).drop("__salt")


def find_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int | None = 60,
    least_letters: int = 4,
    support: int = 1,
    disclosure: float = 0.9,
) -> DataFrame:
    """id, th, th2, base (start, rank, end, value), terms (start, end, full): one row per input row.

    window: None seeks terms in whole texts and marks them wherever they stand.
    """
    if window is None:
        return _spans_anywhere(docs, id_col, text_col, least_letters, support, disclosure)
    return _spans_beside(docs, id_col, text_col, window, least_letters, support, disclosure)


def _revealing(spans: DataFrame, n_t: DataFrame, n: float, support: int, disclosure: float) -> DataFrame:
    """term, full: the words that reveal any value, by rows that hold both. spans: th, th2, base, words."""
    protected = spans.where(F.size("base") > 0)
    rows = F.count(F.lit(1)).alias("m")
    held = protected.select("th", "th2", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).groupBy("th", "th2", "entity").agg(rows)
    said = protected.select("th", "th2", F.explode("words").alias("term")).groupBy("th", "th2", "term").agg(rows)
    # a class is known by the exclusive or of its texts' hashes
    entities = held.groupBy("entity").agg(F.sum("m").alias("n_e"), F.bit_xor("th").alias("e1"), F.bit_xor("th2").alias("e2")).where(F.col("n_e") < n)
    terms = said.groupBy("term").agg(F.sum("m").alias("n_tb"), F.bit_xor("th").alias("t1"), F.bit_xor("th2").alias("t2"))
    least = min(1.0, n ** (disclosure - 1)) * (1 - 1e-9)  # of a word's rows, so many must hold a value: n(t,e) / n(t) >= (n(e) / N) ** (1 - disclosure)
    terms = materialize(terms.join(n_t, "term").where(F.col("n_tb") >= F.lit(least) * F.col("n_t")), "pii-words")
    e_class, t_class = ["e1", "e2", "n_e"], ["t1", "t2", "n_t", "n_tb"]
    by_entity = _spread_join(held, entities, ["entity"]).groupBy("th", "th2", *e_class).agg(F.max("m").alias("m"))
    by_term = _spread_join(said.drop("m"), terms, ["term"]).select("th", "th2", *t_class).distinct()
    possible = _pmi(n, F.least("n_e", "n_tb")) >= F.lit(disclosure) * _own(n)
    pairs = by_term.join(by_entity, ["th", "th2"]).where(possible).groupBy(*t_class, *e_class).agg(F.sum("m").alias("n_te"))
    pairs = pairs.where((F.col("n_te") >= support) & (_pmi(n, F.col("n_te")) >= F.lit(disclosure) * _own(n)))
    classes = pairs.groupBy(*t_class).agg(F.max(F.col("n_te") == F.col("n_t")).alias("full"))
    return terms.join(classes, t_class).select("term", "full")


def _bitmap(terms: DataFrame) -> Column:
    """One array of _SLOTS numbers with a bit set for each term."""
    h = F.xxhash64("term")
    bits = terms.select(_slot(h).alias("slot"), _bit(h).alias("bit"))
    every = terms.sparkSession.range(0, _SLOTS, 1, 1).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bit"))
    one = bits.union(every).groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bit"))), lambda x: x["bit"]).alias("bits")).scalar()


def _slot(h: Column) -> Column:
    return F.pmod(h, F.lit(_SLOTS)).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))


def _places(rows: DataFrame, terms: DataFrame, least_letters: int) -> DataFrame:
    """th, th2, term, start, end: words of all texts that may be among the terms, outside all base spans. rows: th, th2, text, base."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    word = _word(least_letters)
    df = rows.withColumn("pieces", F.regexp_extract_all("text", F.lit(PIECE), 0)).drop("text")
    df = df.withColumn("__l", F.transform("pieces", lambda p: F.length(p)))
    runs, own = _upto(F.col("__l"))

    def placed(sums: Column) -> Column:
        def place(p: Column, i: Column) -> Column:
            return _let(_prefix(sums, own, i), lambda at: F.struct(p.alias("piece"), at.alias("at"), (at + F.length(p)).alias("stop")))

        return F.transform("pieces", place)

    def within(base: Column, low: Column, high: Column) -> Column:
        return F.filter(base, lambda b: (b["end"] > low) & (b["start"] < high))

    def block(k: Column) -> Column:
        """64 pieces, each with the base spans in it."""
        return _let(F.slice("__p", k * 64 + 1, 64), lambda some: _let(within(F.col("base"), F.get(some, F.lit(0))["at"], F.get(some, F.size(some) - 1)["stop"]), lambda near: joined(some, near)))

    def joined(some: Column, near: Column) -> Column:
        return F.transform(some, lambda x: F.struct(x["piece"].alias("piece"), x["at"].alias("at"), within(near, x["at"], x["stop"]).alias("near")))

    df = df.withColumn("__p", _let(runs, placed))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("__p") / 64).cast("int")), block)
    df = df.select("th", "th2", F.explode(F.flatten(blocks)).alias("x"))
    df = df.select("th", "th2", "x.piece", "x.at", "x.near", F.posexplode(F.regexp_extract_all("x.piece", F.lit(word), 0)).alias("i", "word"))
    df = df.withColumn("term", F.lower("word"))
    h = F.xxhash64("term")
    df = df.where(F.get(_bitmap(terms), _slot(h)).bitwiseAND(_bit(h)) != 0)
    words, gaps = F.regexp_extract_all("piece", F.lit(word), 0), F.split("piece", word, -1)
    start = F.col("at") + total(F.slice(gaps, 1, F.col("i") + 1)) + total(F.slice(words, 1, F.col("i")))
    df = df.select("th", "th2", "near", "term", start.cast("int").alias("start"), F.length("word").alias("size"))
    df = df.select("th", "th2", "near", "term", "start", (F.col("start") + F.col("size")).alias("end"))
    return df.where(F.forall("near", lambda b: (b["end"] <= F.col("start")) | (b["start"] >= F.col("end")))).drop("near")


def _spans_anywhere(docs: DataFrame, id_col: str, text_col: str, least_letters: int, support: int, disclosure: float) -> DataFrame:
    """Terms of whole texts, marked in all rows."""
    rows = base_spans(docs, id_col, text_col)
    words = F.when(F.size("base") > 0, _words(F.col("text"), least_letters))
    spans = materialize(rows.select("id", "th", "th2", "base", words.alias("words")), "pii-spans")
    n = float(max(spans.count(), 1))
    reveals = materialize(_revealing(spans, _row_counts(docs, text_col, least_letters), n, support, disclosure), "pii-reveals")
    near = _places(rows.select("th", "th2", "text", "base"), reveals, least_letters).distinct()
    hit = _spread_join(near, reveals, ["term"])
    terms = hit.groupBy("th", "th2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "full"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,full:boolean>>")
    return _spread_join(spans.drop("words"), terms, ["th", "th2"], "left").select("id", "th", "th2", "base", F.coalesce("terms", none).alias("terms"))


def _spans_beside(docs: DataFrame, id_col: str, text_col: str, window: int, least_letters: int, support: int, disclosure: float) -> DataFrame:
    """Terms within the window around each base span, marked there."""
    spans = base_spans(docs, id_col, text_col)
    beside = F.flatten(
        F.transform(
            "base",
            lambda b: F.transform(
                _terms_beside(F.col("text"), b, window, least_letters, F.col("base")),
                lambda t: F.struct(_entity(b).alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")),
            ),
        )
    )
    spans = spans.select("id", "th", "th2", "base", F.when(F.size("base") > 0, beside).alias("beside"))
    spans = materialize(spans, "pii-spans")

    count = F.count(F.lit(1))
    held = F.array_distinct(F.transform("base", _entity))
    n_e = spans.where(F.size("base") > 0).select(F.explode(held).alias("entity")).groupBy("entity").agg(count.alias("n_e"))
    some = spans.where(F.size("beside") > 0)
    seen = F.array_distinct(F.transform("beside", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))
    pairs = some.select(F.explode(seen).alias("x")).groupBy("x.entity", "x.term").agg(count.alias("n_te")).where(F.col("n_te") >= support)
    n_t = _row_counts(docs, text_col, least_letters)
    n = float(max(spans.count(), 1))
    reveals = pairs.join(n_e, "entity").join(n_t, "term").where((_own(n) > 0) & (_pmi(n, F.col("n_te")) >= F.lit(disclosure) * _own(n)))
    reveals = materialize(reveals.select("entity", "term", (F.col("n_te") == F.col("n_t")).alias("full")), "pii-reveals")

    near = some.select("th", "th2", F.explode("beside").alias("x")).select("th", "th2", "x.entity", "x.term", "x.start", "x.end").distinct()
    hit = near.join(reveals, ["entity", "term"]).groupBy("th", "th2", "start", "end").agg(F.max("full").alias("full"))
    terms = hit.groupBy("th", "th2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "full"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,full:boolean>>")
    found = some.join(terms, ["th", "th2"], "left").select("id", "th", "th2", "base", F.coalesce("terms", none).alias("terms"))
    return found.union(spans.where("beside IS NULL OR size(beside) = 0").select("id", "th", "th2", "base", none.alias("terms")))


def listing(spans: Column) -> Column:
    """kind:start:end, joined by commas; spans are (start, rank, end), in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def all_spans() -> Column:
    """Base spans and terms as (start, rank, end), by start and kind."""
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("rank"), x["end"].alias("end")))
    return F.array_sort(F.concat(base, terms))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None, **options) -> DataFrame:
    """doc_id, text: base spans become their kind's mark; terms that disclose fully are removed, others generalised to [TERM].

    Where spans overlap, the first one (by start, then kind) decides and covers what it overlaps.
    """
    found = find_spans(docs, id_col, text_col, window, **options)
    marks = F.array(*[F.lit(MARKS[k]) for k in KINDS[:4]])
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(marks, x["rank"]).alias("mark")))
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["full"], "").otherwise("[TERM]").alias("mark")))
    edits = found.where((F.size("base") > 0) | (F.size("terms") > 0)).select("th", "th2", F.array_sort(F.concat(base, terms)).alias("edits")).dropDuplicates(["th", "th2"])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *_identity(text)).join(edits, ["th", "th2"], "left")

    def step(state: Column, x: Column) -> Column:
        late = x["start"] >= state["at"]
        kept = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0))), F.when(late, x["mark"]).otherwise(""))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("edits", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.coalesce(done, "text").alias("text"))
