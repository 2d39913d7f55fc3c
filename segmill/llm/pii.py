"""Personal data: fixed patterns, and terms whose co-occurrence gives a protected entity away.

The patterns find emails, IP addresses, card and phone numbers; these matches
are the protected entities. A term (a word of at least four letters that no
match covers) anywhere in a text that holds an entity is weighed by the corpus:
with ``n(x)`` the documents that hold ``x``,

    disclosure(term, entity) = PMI(term; entity) / IC(entity)
        = log(N * n(term, entity) / (n(term) * n(entity))) / log(N / n(entity))

which is 1 if the term occurs in no text without that entity, and 0 if they are
independent. Of terms that share at least two documents with an entity and whose
disclosure reaches ``GENERALISE`` every occurrence in texts that hold the entity
is replaced by a general marker, from ``REMOVE`` on it is removed. Before terms
and entities are paired, those go that cannot reach two documents, and a pair
whose term is in too many documents: ``n(both)`` is at most either count, so
``n(term)`` is at most ``N * (n(entity) / N) ** GENERALISE``.

Terms found in the same rows and in as many documents are one class, entities of
the same rows another; rows are paired by classes, since all pairs of two classes share one
disclosure. So a text of thousands of rare terms and entities gives few pairs.

Everything is DataFrame functions. A match's place follows from the text split
at the matches, by a running sum over the pieces as rows; a text is put together again
from chunks of ``CHUNK`` characters. So the work is linear in the matches. Repetitions that could nest deeply are possessive, which gives
the same matches in constant stack depth, and an email or digit run is only
tried from its start.

Defined results: a null text is empty. Equal rows (same id and text) count as
one document and get equal spans, each row its own result. An empty table gives
an empty result. Other columns are carried by ``sanitise``, ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.session import checkpointed

#: Kinds in order, their patterns, a cheap test that a text may match, and the test of a match ``v``.
_LOCAL = "[A-Za-z0-9._%+-]"
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_LUHN = f"""transform(array({_DIGITS}), d -> CASE WHEN length(d) BETWEEN 14 AND 19 THEN
    aggregate(sequence(1, length(d)), 0, (s, k) -> s + CASE WHEN k % 2 = 1 THEN CAST(substr(d, length(d) - k + 1, 1) AS INT)
        ELSE CAST(substr('0246813579', CAST(substr(d, length(d) - k + 1, 1) AS INT) + 1, 1) AS INT) END) % 10 = 0
    ELSE false END)[0]"""
_OCTETS = r"""forall(split(v, r'\.'), p -> transform(array(trim(LEADING '0' FROM p)),
    q -> CASE WHEN length(q) > 3 THEN false ELSE CAST(concat('0', q) AS INT) <= 255 END)[0])"""
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "contains(t, '@')", "true"),
    "ip": (r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", r"t RLIKE r'[0-9]\.[0-9]+\.[0-9]+\.[0-9]'", _OCTETS),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"t RLIKE r'[0-9](?:[ -]?[0-9]){13}'", _LUHN),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "contains(t, '+')", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}
KINDS = (*PATTERNS, "term")
GENERALISE, REMOVE, LEAST_DOCUMENTS = 0.8, 0.95, 2
_SPAN = "struct<start: int, k: int, end: int, kind: string, value: string>"
_TERM = r"\p{L}{4,}"
_NONE = f"CAST(array() AS array<{_SPAN}>)"
CHUNK = 4096


def span_list(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def _pieces(pattern: str) -> str:
    """SQL for the text ``t`` split at a pattern: the length of the gap before each match, and the match."""
    return f"zip_with(split(t, r'{pattern}', -1), regexp_extract_all(t, r'{pattern}', 0), (g, v) -> named_struct('gap', length(g), 'v', v))"


def _ended(pieces: DataFrame, *keys: str) -> DataFrame:
    """Matches ``keys, at, x(gap, v)`` with their ``start`` and ``end``."""
    rows = pieces.where("x.v IS NOT NULL").select(*keys, "at", F.col("x.v").alias("v"), (F.col("x.gap") + F.length("x.v")).alias("step"))
    until = F.sum("step").over(Window.partitionBy(*keys).orderBy("at")).cast("int")
    return rows.withColumn("end", until).withColumn("start", F.col("end") - F.length("v"))


def _base(rows: DataFrame) -> DataFrame:
    """``row1, row2, base``: the sorted valid spans of every row that has some; ``rows`` holds each of its rows once."""
    kinds = [
        f"named_struct('k', {k}, 'm', CASE WHEN {possible} THEN {_pieces(pattern)} END)"
        for k, (pattern, possible, _) in enumerate(PATTERNS.values())
    ]
    each = rows.select("row1", "row2", F.explode(F.expr(f"array({', '.join(kinds)})")).alias("x"))
    pieces = each.select("row1", "row2", F.col("x.k").alias("k"), F.posexplode("x.m").alias("at", "x"))
    valid = " ".join(f"WHEN {k} THEN {valid}" for k, (_, _, valid) in enumerate(PATTERNS.values()))
    kind = f"element_at(array({', '.join(map(repr, PATTERNS))}), k + 1)"
    span = F.expr(f"named_struct('start', start, 'k', k, 'end', end, 'kind', {kind}, 'value', v)").cast(_SPAN)
    found = _ended(pieces, "row1", "row2", "k").where(F.expr(f"CASE k {valid} END"))
    return found.groupBy("row1", "row2").agg(F.array_sort(F.collect_list(span)).alias("base"))


def _scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: ``doc_id``, ``row1`` and ``row2`` (which name equal rows), ``base`` spans, their ``entities``, and ``t``, the text if there are any."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    ).withColumns({"row1": F.xxhash64("doc_id", "t"), "row2": F.xxhash64("t", "doc_id")})
    some = " OR ".join(
        f"({possible} AND exists(regexp_extract_all(t, r'{pattern}', 0), v -> {valid}))" for pattern, possible, valid in PATTERNS.values()
    )
    rows = checkpointed(rows.withColumn("t", F.expr(f"CASE WHEN {some} THEN t END")))
    base = _base(rows.where("t IS NOT NULL").dropDuplicates(["row1", "row2"]))
    rows = rows.join(base, ["row1", "row2"], "left").withColumn("base", F.expr(f"coalesce(base, {_NONE})"))
    entities = F.expr("array_distinct(transform(base, s -> concat(s.kind, ':', lower(s.value))))")
    return rows.select("doc_id", "row1", "row2", "base", entities.alias("entities"), "t")


def _places(rows: DataFrame) -> DataFrame:
    """``row1, row2, term, start, end, word`` of every term that no match covers; ``rows`` holds each of its rows once.

    Words and matches go in one order by start: a word is covered if an earlier match
    ends behind its start, or the next one starts before its end.
    """
    parts = rows.select("row1", "row2", F.posexplode(F.expr(_pieces(_TERM))).alias("at", "x"))
    words = _ended(parts, "row1", "row2").select("row1", "row2", "start", "end", F.col("v").alias("word"))
    covers = rows.select("row1", "row2", F.explode("base").alias("b")).select("row1", "row2", "b.start", "b.end", F.lit(None).cast("string").alias("word"))
    is_word = F.col("word").isNotNull()
    ahead = Window.partitionBy("row1", "row2").orderBy("start", is_word)
    back = Window.partitionBy("row1", "row2").orderBy(F.desc("start"), is_word.desc())
    placed = words.unionByName(covers).withColumns(
        {
            "ended": F.max(F.when(~is_word, F.col("end"))).over(ahead.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.min(F.when(~is_word, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    free = is_word & (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return placed.where(free).select("row1", "row2", F.lower("word").alias("term"), "start", "end", "word")


def _term_documents(docs: DataFrame, text: str) -> DataFrame:
    """``term`` and ``n_term``, the rows that hold it, over all whole texts; combined before the shuffle."""
    words = F.filter(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}]+"), lambda x: F.length(x) >= 4)
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def _weighed(scanned: DataFrame, docs: DataFrame, text: str) -> dict[str, DataFrame]:
    """Terms and entities by classes.

    ``terms`` (``row1, row2, term``), ``known`` (``term``, its class ``t1, t2, n_term``), ``named`` (``entity``, its
    class ``e1, e2, n_entity``), the classes of each row in ``of_terms`` and ``of_entities``, and ``told``, the pairs
    of classes whose ``disclosure`` is high. A class is named by the exclusive or of its rows' two hashes.
    """
    total = max(1, scanned.count())
    holding = scanned.where(F.size("base") > 0).dropDuplicates(["row1", "row2"])
    each = holding.select("row1", "row2", F.explode("entities").alias("entity"))
    signs = lambda a, b: (F.bit_xor("row1").alias(a), F.bit_xor("row2").alias(b))
    named = each.groupBy("entity").agg(F.count("*").alias("n_entity"), *signs("e1", "e2"))
    named = checkpointed(named.where(F.col("n_entity") >= LEAST_DOCUMENTS))
    of_entities = checkpointed(each.join(named, "entity").select("row1", "row2", "e1", "e2", "n_entity").distinct())
    most = named.agg(F.max("n_entity")).first()[0] or 0

    def bound(n_entity: Column) -> Column:
        return F.lit(total * (1 + 1e-9)) * F.pow(n_entity / F.lit(total), F.lit(GENERALISE))

    paired_rows = of_entities.select("row1", "row2").distinct()
    terms = checkpointed(_places(holding.join(paired_rows, ["row1", "row2"], "left_semi")).select("row1", "row2", "term").distinct())
    often = terms.groupBy("term").agg(F.count("*").alias("n"), *signs("t1", "t2")).where(F.col("n") >= LEAST_DOCUMENTS).drop("n")
    known = checkpointed(_term_documents(docs, text).where(F.col("n_term") <= bound(F.lit(most))).join(often, "term"))
    of_terms = checkpointed(terms.join(known, "term").select("row1", "row2", "t1", "t2", "n_term").distinct())
    paired = of_terms.join(of_entities, ["row1", "row2"]).where(F.col("n_term") <= bound(F.col("n_entity")))
    joined = paired.groupBy("e1", "e2", "n_entity", "t1", "t2", "n_term").agg(F.count("*").alias("n_both"))
    joined = joined.where(F.col("n_both") >= LEAST_DOCUMENTS)
    whole = F.lit(total).cast("double")
    mutual = F.log(whole * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    own = F.log(whole / F.col("n_entity"))
    told = joined.withColumn("disclosure", F.when(own > 0, mutual / own)).where(F.col("disclosure") >= GENERALISE)
    told = checkpointed(told.select("e1", "e2", "n_entity", "t1", "t2", "n_term", "disclosure"))
    return {"terms": terms, "known": known, "named": named, "of_terms": of_terms, "of_entities": of_entities, "told": told}


def disclosing_terms(scanned: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``entity, term, disclosure`` of the terms that give an entity away."""
    weighed = _weighed(scanned, docs, text)
    told = weighed["told"].join(weighed["named"], ["e1", "e2", "n_entity"]).join(weighed["known"], ["t1", "t2", "n_term"])
    return told.select("entity", "term", "disclosure")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, row1, row2, base, spans``: spans by start, then kind, a term's ``k`` one higher if it is to be removed.

    Spans are structs ``start, k, end, kind, value`` in code points, end exclusive.
    """
    scanned = checkpointed(_scanned(docs, doc_id, text))
    weighed = _weighed(scanned, docs, text)
    met = weighed["of_terms"].join(weighed["told"], ["t1", "t2", "n_term"]).join(weighed["of_entities"], ["row1", "row2", "e1", "e2", "n_entity"], "left_semi")
    met = met.groupBy("row1", "row2", "t1", "t2", "n_term").agg(F.max("disclosure").alias("disclosure"))
    named = weighed["terms"].join(weighed["known"], "term").join(met, ["row1", "row2", "t1", "t2", "n_term"])
    most = checkpointed(named.select("row1", "row2", "term", "disclosure"))
    holding = scanned.join(most.select("row1", "row2").distinct(), ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"])
    placed = _places(holding).join(most, ["row1", "row2", "term"])
    k = KINDS.index("term")
    raised = F.expr(f"named_struct('start', start, 'k', {k} + IF(disclosure >= {REMOVE}, 1, 0), 'end', end, 'kind', 'term', 'value', word)")
    terms = checkpointed(placed.groupBy("row1", "row2").agg(F.collect_list(raised).alias("terms")))
    rows = scanned.drop("entities", "t").join(terms, ["row1", "row2"], "left")
    return rows.select(
        "doc_id", "row1", "row2", "base", F.expr("array_sort(concat(base, coalesce(terms, array())))").alias("spans")
    )


def _marks(found: DataFrame) -> DataFrame:
    """``row1, row2, chunk, marks``: per chunk what is cut out of it and the markers put there, in order.

    A span that starts inside an earlier one has no marker; one that goes on in the next chunk has it in its first.
    """
    spans = found.select("row1", "row2", F.posexplode("spans").alias("at", "s"))
    order = Window.partitionBy("row1", "row2").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("s.start") >= F.coalesce(F.max("s.end").over(order), F.lit(0))
    marker = F.when(opens & (F.col("s.k") <= KINDS.index("term")), F.concat(F.lit("["), F.upper("s.kind"), F.lit("]"))).otherwise("")
    cut = spans.select("row1", "row2", "at", "s.start", "s.end", marker.alias("marker"))
    chunks = F.explode(F.expr(f"sequence(start DIV {CHUNK}, (end - 1) DIV {CHUNK})")).alias("chunk")
    mark = f"""named_struct('at', at, 'start', CAST(greatest(start - chunk * {CHUNK}, 0) AS INT), 'end', CAST(least(end - chunk * {CHUNK}, {CHUNK}) AS INT),
        'marker', IF(start >= chunk * {CHUNK}, marker, ''))"""
    parts = cut.select("*", chunks).select("row1", "row2", F.col("chunk").cast("int").alias("chunk"), F.expr(mark).alias("mark"))
    return parts.groupBy("row1", "row2", "chunk").agg(F.array_sort(F.collect_list("mark")).alias("marks"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every span of their text replaced: entities by ``[EMAIL]`` and so on, terms by ``[TERM]`` or nothing.

    Overlapping spans are replaced as one, by the first one's marker. A null
    text stays null. Rows without spans are passed on as they are.
    """
    found = find(docs, doc_id, text).where(F.size("spans") > 0)
    found = checkpointed(found.select("row1", "row2", "spans").dropDuplicates(["row1", "row2"]))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.col(f"`{doc_id}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), body.alias("t"), F.xxhash64(key, body).alias("row1"), F.xxhash64(body, key).alias("row2"))
    held = keyed.join(found.select("row1", "row2"), ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"])
    chunks = held.select("row1", "row2", F.posexplode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunk", "c"))
    rebuilt = """aggregate(marks, struct(0 AS at, '' AS out),
        (a, m) -> struct(greatest(a.at, m.end) AS at, concat(a.out, substr(c, a.at + 1, greatest(m.start - a.at, 0)), m.marker) AS out),
        a -> concat(a.out, substr(c, a.at + 1)))"""
    made = chunks.join(_marks(found), ["row1", "row2", "chunk"], "left").withColumn("c", F.expr(f"IF(marks IS NULL, c, {rebuilt})"))
    whole = F.expr("array_join(transform(array_sort(collect_list(struct(chunk, c))), x -> x.c), '')")
    made = checkpointed(made.groupBy("row1", "row2").agg(whole.alias("made")))
    joined = keyed.join(made, ["row1", "row2"], "left")
    value = {text: F.coalesce("made", F.col("row").getField(text))}
    return joined.select(*[value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
