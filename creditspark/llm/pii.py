"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the values of e-mail, IP, card and phone patterns. How strongly a term reveals an entity is estimated
from the corpus: with n(t) and n(e) distinct texts that hold the term and the entity, n(t, e) texts in which the term
stands within ``reach`` words of a mention, of N texts in all,

    information(e) = log2(N / n(e)),   disclosure(t, e) = log2(n(t, e) * N / (n(t) * n(e))).

A term whose disclosure is at least ``threshold`` of the entity's information, in at least ``support`` distinct texts, tells
the entity nearly as well as its own mention; in every text that mentions that entity it is generalised or removed too, wherever
it stands. All counts are of distinct texts, over all documents: copies of a text count once, and so do spellings of a term in a
text. For that the distinct terms of a text move once, with its hash; all else is pre-aggregated before every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import work_path
from .spans import chunks, cut, in_order, let, matches, replace_spans, rewrite, running

KINDS = ["email", "ip", "card", "phone", "term"]
#: repeated groups are possessive, which changes no match; an e-mail or IP starts at the edge of its run of characters or
#: where the last match ended, as any start inside the run would fail at the same place
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPANS = "array<struct<start:int,kind:string,end:int>>"
#: stands for the characters of mentions while words are cut
MARK = "\uffff"
_LETTER = r"[^\s]"
#: marks before the first and after the last letter or figure of a word; a run of marks is entered at its start only
_OUTER = r"(?<![^\s])[^\p{L}\p{N}\s]++|(?<![^\p{L}\p{N}\s])[^\p{L}\p{N}\s]++(?![^\s])"
SALTS = 16


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    figures = F.reverse(F.split(digits, "(?!^)(?=.)"))
    total = F.aggregate(F.transform(figures, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")).otherwise(d.cast("int"))),
                        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _small_parts(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(p == "", F.lit(0)).otherwise(F.when(F.length(p) <= 3, p).cast("int")), F.lit(999)) <= 255))


def base_matches(text: Column) -> dict[str, Column]:
    """Matches of each pattern that pass its test; text must not be null."""
    figure = text.rlike("[0-9]")
    size = lambda m, lo, hi: F.length(_digits(m)).between(lo, hi)
    return {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP, figure & text.contains(".")), lambda s: _small_parts(s["m"])),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda s: F.when(size(s["m"], 14, 19), luhn(_digits(s["m"]))).otherwise(F.lit(False))),
        "phone": F.filter(matches(text, PHONE, figure & text.contains("+")), lambda s: size(s["m"], 10, 15)),
    }


def _entity(kind: str, m: Column) -> Column:
    value = F.lower(m) if kind == "email" else m if kind == "ip" else _digits(m)
    return F.concat(F.lit(kind + ":"), value)


def find_base(docs: DataFrame, key: str, text: str, reach: int) -> DataFrame:
    """row (a number), key, blob (hash of the text), mentions: array of (start, kind, end, entity) by kind; where there are any,
    near: the distinct 'term entity' of the ``reach`` words on each side of a mention and of the word parts that touch it,
    body: the text with blanks for the mentions, glued: terms that stand in it only as parts of words.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", "text", F.unhex(F.sha2("text", 256)).alias("blob"), *(c.alias(k) for k, c in base_matches(F.col("text")).items()))

    def mention(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), _entity(kind, s["m"]).alias("entity")))

    rows = rows.select("key", "blob", "text", F.concat(*(mention(k) for k in KINDS[:4])).alias("mentions"))
    held = F.size("mentions") > 0
    rows = rows.select("key", "blob", "text", "mentions", F.when(held, _marked(F.col("text"), F.array_sort("mentions"))).alias("marked"))
    near = F.when(held, _context(F.col("text"), F.col("marked"), F.array_sort("mentions"), reach))
    rows = rows.select("key", "blob", "text", "mentions", near.alias("near"), F.translate("marked", MARK, " ").alias("body"))
    glued = F.when(held, F.array_except(text_terms(F.col("body")), text_terms(F.col("text"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "key", "blob", "mentions", "near", "body", glued.alias("glued"))


def _marked(text: Column, mentions: Column) -> Column:
    """The text with MARK for every character of a mention but blanks; mentions in order of their starts."""

    def put(m: Column, covered: Column, pieces: Column) -> Column:
        return F.regexp_replace(cut(pieces, F.greatest(covered, m["start"]), F.greatest(covered, m["end"])), _LETTER, MARK)

    return rewrite(F.translate(text, MARK, "\ufffe"), mentions, put)


def _context(text: Column, marked: Column, mentions: Column, reach: int) -> Column:
    """Distinct 'term entity' of the ``reach`` words on each side of each mention, and of the word parts that touch it; words with
    mentions are none. Mentions in order of their starts.

    The MARKs are numbered through the text, and two arrays tell of each its word and its run of MARKs, so that a
    mention finds its neighbours by the numbers of its first and last MARK.
    """
    letters = lambda t: F.length(F.regexp_replace(t, r"\s", "")).cast("int")
    spread = lambda items, count: F.flatten(F.transform(items, lambda x, i: F.array_repeat(i, count(x))))
    last_word = lambda t: F.element_at(F.split(t, r"\s", -1), -1)
    first_word = lambda t: F.get(F.split(t, r"\s", -1), F.lit(0))

    def numbered(ms: Column, pieces: Column, before: Column) -> Column:
        """Mentions with the numbers of their first and last MARK: those covered so far, less what an earlier mention shares."""
        fresh = F.transform(ms, lambda m, i: letters(cut(pieces, F.greatest(F.get(before, i), m["start"]), F.greatest(F.get(before, i), m["end"]))))
        first = lambda m, i, so_far: F.get(so_far, i) - letters(cut(pieces, m["start"], F.get(before, i)))
        return let(running(fresh), lambda so_far: F.transform(ms, lambda m, i: F.struct(
            m["entity"].alias("entity"), first(m, i, so_far).alias("first"), (first(m, i, so_far) + letters(cut(pieces, m["start"], m["end"])) - 1).alias("last"))))

    def around(m: Column, words: Column, word_of: Column, run_of: Column, gaps: Column) -> Column:
        lo, hi = F.get(word_of, m["first"]), F.get(word_of, m["last"])
        before = F.slice(words, F.greatest(lo - reach, F.lit(0)) + 1, F.least(lo, F.lit(reach)))
        whole = F.concat(before, F.slice(words, hi + 2, F.lit(reach)))
        run, end = F.get(run_of, m["first"]), F.get(run_of, m["last"])
        left = F.when(F.coalesce(F.get(run_of, m["first"] - 1) != run, F.lit(True)), last_word(F.get(gaps, run))).otherwise(F.lit(""))
        right = F.when(F.coalesce(F.get(run_of, m["last"] + 1) != end, F.lit(True)), first_word(F.get(gaps, end + 1))).otherwise(F.lit(""))
        found = F.concat(F.filter(whole, lambda w: ~F.contains(w, F.lit(MARK))), F.array(left, right))
        terms = F.filter(F.transform(found, term_of), lambda t: t.rlike(r"\p{L}"))
        return F.transform(terms, lambda t: F.concat(t, F.lit(" "), m["entity"]))

    places = let(chunks(text), lambda pieces: let(running(F.transform(mentions, lambda m: m["end"]), F.greatest), lambda before: numbered(mentions, pieces, before)))
    words = F.filter(F.split(marked, r"\s+"), lambda w: w != "")
    runs = F.regexp_extract_all(marked, F.lit(f"{MARK}++"), F.lit(0))
    marks = lambda w: F.length(F.regexp_replace(w, f"[^{MARK}]++", ""))
    return let(words, lambda ws: let(spread(ws, marks), lambda word_of: let(spread(runs, F.length), lambda run_of: let(
        F.split(marked, f"{MARK}++", -1), lambda gaps: F.array_distinct(F.flatten(F.transform(places, lambda m: around(m, ws, word_of, run_of, gaps))))))))


def term_of(word: Column) -> Column:
    """Lower case without marks around the word."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def text_terms(text: Column) -> Column:
    """Distinct terms of a text; its words' outer marks are removed in one search, as by ``term_of`` word by word."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(text), _OUTER, ""), r"\s+")), lambda t: t != "")


def _occurrences(base: DataFrame) -> DataFrame:
    """row, term, start, end of every word outside the mentions, for texts with mentions."""
    words = F.split("body", r"\s", -1)  # one blank ends each: empty ones keep the offsets
    placed = let(words, lambda ws: let(running(F.transform(ws, lambda w: F.length(w) + 1)), lambda starts: F.filter(
        F.transform(ws, lambda w, i: F.struct(F.get(starts, i).alias("start"), w.alias("m"))), lambda s: s["m"] != "")))
    rows = base.where(F.size("mentions") > 0).select("row", F.explode(placed).alias("s"))
    return rows.select("row", term_of(F.col("s.m")).alias("term"), F.col("s.start").alias("start"), (F.col("s.start") + F.length("s.m")).alias("end"))


def disclosing_terms(docs: DataFrame, base: DataFrame, text: str, threshold: float, support: int) -> DataFrame:
    """row, spans of all terms of a text that reveal an entity mentioned in it. Every count is one of distinct texts."""
    held = base.where(F.size("mentions") > 0)
    near = held.select("blob", F.explode("near").alias("near")).select("blob", F.split("near", " ", 2).alias("n")).select("blob", F.get("n", F.lit(0)).alias("term"), F.get("n", F.lit(1)).alias("entity"))
    pairs = near.groupBy("term", "entity").agg(F.count_distinct("blob").alias("both")).where(F.col("both") >= support)
    mentions = held.select("row", "blob", F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity"))
    entities = mentions.groupBy("entity").agg(F.count_distinct("blob").alias("n_entity"))
    # document frequency of every term: equal texts are one row of equal terms, then partial sums per task
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("blob"), F.array_join(text_terms(F.col("text")), " ").alias("terms")).distinct()
    glued = held.where(F.size("glued") > 0).select("blob", F.array_join("glued", " ").alias("terms")).distinct()
    terms = texts.union(glued).select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    wanted = pairs.select("term").distinct()
    total = F.lit(float(max(base.select("blob").distinct().count(), 1)))
    risky = (pairs.join(terms.join(wanted, "term", "left_semi"), "term").join(entities, "entity")
             .where(F.log2(F.col("both") * total / (F.greatest("n_term", "both") * F.col("n_entity"))) >= threshold * F.log2(total / F.col("n_entity")))
             .select("term", "entity"))
    # a frequent word is dealt over SALTS tasks
    places = _occurrences(base).withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    salted = risky.select("term", "entity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = places.join(salted, ["term", "salt"]).join(mentions.select("row", "entity"), ["row", "entity"], "left_semi")
    return found.select("row", F.struct("start", F.lit("term").alias("kind"), "end").alias("span")).groupBy("row").agg(F.collect_set("span").alias("terms"))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 5, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """Per row: key, blob, base (spans of the four patterns) and spans (with those of disclosing terms), as arrays of
    (start, rank, end, kind) in code points by start, then kind.

    Null or empty text: no spans. Rows with equal key and text get equal spans. Other columns are not read. An empty table
    gives no rows. One very long text is searched whole, in linear time.
    """
    path = work_path(docs.sparkSession, "pii-base")
    find_base(docs, key, text, reach).write.parquet(path)
    base = docs.sparkSession.read.parquet(path)
    terms = disclosing_terms(docs, base, text, threshold, support)
    plain = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    joined = base.select("row", "key", "blob", "mentions").join(terms, "row", "left")
    extra = F.coalesce("terms", F.array().cast(SPANS))  # words of the text without its mentions, so none meets a base span
    return joined.select(F.col("key").alias(key), "blob", in_order(plain, KINDS).alias("base"), in_order(F.concat(plain, extra), KINDS).alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; texts without spans stay as they are."""
    found = find_personal_data(docs, key, text, **options).where(F.size("spans") > 0).dropDuplicates([key, "blob"]).select(F.col(key).alias("k"), F.col("blob").alias("b"), "spans")
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("blob"))
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("blob") == F.col("b")), "left")
    clean = F.when(F.col("spans").isNull(), F.col("doc")[text]).otherwise(replace_spans(F.col("doc")[text], F.col("spans")))
    return joined.select("doc", clean.alias("text")).select(*(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
