"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question keeps its template when its parameters change.
Windows of template tokens of the benchmark are hashed and joined with the windows of all documents; windows that lie on
one diagonal (the same shift between document and item) form a passage, and the values in its slots must map
consistently from the item to the document unless enough of the passage is a literal copy. A window is looked up by its
rarest word, so that documents are not hashed at every position. Names are told by their capital letter, so a second kind of window, of lower-cased
words with placeholders for numbers and units only, finds copies in another letter case. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradrift.llm.common import small_side, text_or_empty
from terradrift.session import save_table

TOKEN = r"[\p{L}\p{M}']+|[0-9]+(?:[.,:/][0-9]+)*"
# Unit words that become placeholders right after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "s", "sec", "min", "h", "hr",
    "hrs", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "inch", "inches", "foot", "feet", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon",
    "gallons", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "km/h", "mph", "watt", "watts",
)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def tokens(text: Column) -> Column:
    """Words and numbers of a text in order; punctuation and white space are gone."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return F.ascii(token).between(48, 57)


def canonical(words: Column) -> Column:
    """Template tokens: a number, a capitalised word and a unit after a number become placeholders, the rest lower case."""

    def one(token: Column, i: Column) -> Column:
        low = F.lower(token)
        after_number = (i > 0) & _is_number(F.get(words, i - 1))
        return (
            F.when(_is_number(token), NUMBER).when(after_number & low.isin(*UNITS), UNIT)
            .when(F.left(token, F.lit(1)) != F.left(low, F.lit(1)), NAME).otherwise(low)
        )

    return F.transform(words, one)


def caseless(words: Column) -> Column:
    """Lower-cased tokens in which only numbers and units after a number are placeholders."""

    def one(token: Column, i: Column) -> Column:
        low = F.lower(token)
        after_number = (i > 0) & _is_number(F.get(words, i - 1))
        return F.when(_is_number(token), NUMBER).when(after_number & low.isin(*UNITS), UNIT).otherwise(low)

    return F.transform(words, one)


def literal(words: Column) -> Column:
    """Lower-cased tokens without placeholders."""
    return F.transform(words, lambda w: F.lower(w))


#: Kinds of windows, by the column of tokens that they are made of.
KINDS_OF_WINDOWS = ("template", "caseless", "literal")


def _hashed(words: Column) -> list[Column]:
    """The tokens of each kind as hashes: a window is a slice of long integers then, not of strings."""
    return [F.transform(form(words), lambda t: F.xxhash64(t)).alias(kind) for kind, form in zip(KINDS_OF_WINDOWS, (canonical, caseless, literal), strict=True)]


def _repeats(words: Column | str) -> Column:
    """At every slot of ``template`` the first slot with the same value, from 1, and 0 elsewhere."""
    slots = F.zip_with(words, "template", lambda w, t: F.when(t.isin(NUMBER, NAME, UNIT), w).otherwise(""))
    return F.transform(slots, lambda w: F.when(w != "", F.array_position(slots, w)).otherwise(0))


def _windows(frame: DataFrame, keep: list[str], size: int, kinds: tuple[str, ...]) -> DataFrame:
    """``keep`` plus ``at`` and ``hash`` of every window of ``size`` tokens of each kind.

    ``at`` is the kind's index times the number of windows plus the window's position, both from 0.
    """
    def hashes(kind: str) -> Column:
        starts = F.when(F.size(kind) >= size, F.sequence(F.lit(1), F.size(kind) - (size - 1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(kind, i, size), F.lit(kind)))

    # An outer explode: for a plain one Spark would test the array's size first, with all of its expressions written out once more.
    return frame.select(*keep, F.posexplode_outer(F.concat(*map(hashes, kinds))).alias("at", "hash")).filter("hash IS NOT NULL")


def _anchors(windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(anchor, offset, kind)``: for every window ``(hash, kind, lower, shown)`` the word that it is looked up by.

    That is the word that is rarest in the benchmark (ties: the longest) of those that stand in every document with the
    window: no placeholders, but in a window of values any word or number. The choice steers cost only.
    """
    at = F.posexplode(F.arrays_zip("lower", "shown")).alias("offset", "one")
    words = windows.select("hash", "kind", at).filter((F.col("kind") == 2) | ~F.col("one.shown").isin(NUMBER, NAME, UNIT))
    words = words.select("hash", "kind", "offset", F.col("one.lower").alias("word")).join(vocabulary, "word")
    best = F.min(F.struct("count", (-F.length("word")).alias("short"), "word", "offset")).alias("best")
    return words.groupBy("hash", "kind").agg(best).select(F.xxhash64("best.word").alias("anchor"), "best.offset", "kind").distinct()


def _anchored_windows(texts: DataFrame, keep: list[str], size: int, anchors: DataFrame) -> DataFrame:
    """``keep`` plus ``pos`` and ``hash`` of the windows of ``texts (keep, words)`` that have an anchor in its place.

    Every word is looked up once, in generated code; only the few windows around an anchor are cut out, brought into their form
    and hashed. ``anchors`` is broadcast: the caller checks its size.
    """
    placed = texts.select(*keep, "words", F.posexplode_outer("words").alias("at", "word")).withColumn("anchor", F.xxhash64(F.lower("word")))
    placed = placed.join(F.broadcast(anchors), "anchor").withColumn("pos", F.col("at") - F.col("offset"))
    placed = placed.filter((F.col("pos") >= 0) & (F.col("pos") + size <= F.size("words")))
    # The word before the window comes along: it tells whether the first one is a unit.
    before = F.when(F.col("pos") > 0, 1).otherwise(0)
    cut = placed.select(*keep, "pos", "kind", before.alias("before"), F.slice("words", F.greatest("pos", F.lit(1)), before + size).alias("cut"))
    words = F.col("cut")
    form = F.when(F.col("kind") == 0, canonical(words)).when(F.col("kind") == 1, caseless(words)).otherwise(literal(words))
    hashes = [F.xxhash64(F.slice("form", F.col("before") + 1, size), F.lit(kind)) for kind in KINDS_OF_WINDOWS]
    formed = cut.select(*keep, "pos", "kind", "before", F.transform(form, lambda t: F.xxhash64(t)).alias("form"))
    return formed.select(*keep, "pos", F.when(F.col("kind") == 0, hashes[0]).when(F.col("kind") == 1, hashes[1]).otherwise(hashes[2]).alias("hash"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", window: int = 10, min_windows: int = 3, max_anchors: int = 500_000) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_windows, n_slots, exact)``: one row per document and benchmark item found in it.

    A passage counts if at least ``min_windows`` windows of ``window`` template tokens match on one diagonal, or all windows
    of an item that has fewer; an item shorter than a window is one window of its own length. Windows with fewer
    literal words than placeholders say too little; where that holds even without names, the window counts with its own values.
    In a passage each name, number and unit of the item
    must stand for one value of the document, and different names for different names. Where template windows do not
    suffice, windows that ignore letter case count beside them, and letter case of the values is ignored, too; of items that
    differ in letter case only, those that a document has by template stand for the others there. Of the windows of any kind
    only tokens in matching windows are judged, and not even they are if as many windows as it takes to count stand word for word,
    one right after the other, in an item of the class. Slots are compared with the words of every item of a class.
    ``n_windows`` and ``n_slots`` are those of the longest passage of template windows, else of the longest passage
    (ties: with more slots), ``exact`` tells whether a passage has the item's own values or only windows that are word for word in the class.
    Items with the same template are one class named by their smallest id. Null or empty texts match nothing; null ids and
    repeated rows are allowed, rows with equal id and text give one result; an empty benchmark gives no rows.

    Windows are looked up by one word each, their anchor. A benchmark of more than ``max_anchors`` of them, too many to be
    sent to every executor, is joined with the windows at all positions instead, by a shuffle; the result is the same.
    """
    item_words = benchmark.select(F.col(item).alias("item_id"), tokens(text_or_empty(item_text)).alias("words"))
    item_words = save_table(item_words.withColumn("template", canonical(F.col("words"))).filter(F.size("words") > 0)
                            .withColumn("class", F.xxhash64("template")), "leak-members")
    # Which slots of an item hold one value decides consistency, the value itself does not: items of a class share few such patterns.
    lower = literal(F.col("words"))
    classes = item_words.withColumn("pattern", F.struct(_repeats("words").alias("own"), _repeats(lower).alias("caseless"))).groupBy("class", "template").agg(
        F.min_by("words", F.struct(F.col("item_id").isNull(), "item_id", "words")).alias("words"), F.min("item_id").alias("item_id"),
        F.collect_set("pattern").alias("patterns"))
    classes = save_table(classes, "leak-items")
    sizes = [r[0] for r in classes.select(F.least(F.size("template"), F.lit(window)).alias("n")).distinct().orderBy("n").collect()]
    doc_rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), tokens(text_or_empty(text)).alias("words"))
    templates = doc_rows.select("doc_id", "text_hash", F.size("words").alias("n"), *_hashed(F.col("words")))
    vocabulary = save_table(classes.select(F.explode(lower).alias("word")).groupBy("word").count(), "leak-vocabulary")
    found = None
    for size in sizes:  # at most ``window`` sizes; only items shorter than a window add one
        of_size = classes.filter(F.least(F.size("template"), F.lit(window)) == size)
        item_forms = of_size.select("class", F.struct(F.col("template"), caseless(F.col("words")).alias("caseless"), lower.alias("lower")).alias("form"), *_hashed(F.col("words")))
        n_windows = F.size("form.template") - (size - 1)
        per_item = _windows(item_forms, ["class", "form"], size, KINDS_OF_WINDOWS).select(
            "class", "form", "hash", (F.col("at") % n_windows).alias("item_pos"), F.floor(F.col("at") / n_windows).alias("kind"))
        shown = F.slice(F.when(F.col("kind") == 0, F.col("form.template")).otherwise(F.col("form.caseless")), F.col("item_pos") + 1, size)
        says_little = F.size(F.filter(shown, lambda t: t.isin(NUMBER, NAME, UNIT))) * 2 > size
        per_item = per_item.withColumns({"shown": shown, "lower": F.slice("form.lower", F.col("item_pos") + 1, size)}).filter(says_little == (F.col("kind") == 2))
        per_item = save_table(per_item.select("class", "item_pos", "kind", (F.col("kind") == 0).alias("is_template"), "hash", "shown", "lower"), "leak-windows")
        anchors = save_table(_anchors(per_item, vocabulary), "leak-anchors")
        per_item = per_item.select("class", "item_pos", "kind", "is_template", "hash")
        per_class = per_item.groupBy("class").agg(
            F.count_if("is_template").alias("class_templates"), F.count_distinct("item_pos").alias("class_windows"))
        wanted = save_table(per_item.select("hash").distinct(), "leak-hashes")
        if anchors.limit(max_anchors + 1).count() <= max_anchors:
            candidates = _anchored_windows(doc_rows, ["doc_id", "text_hash"], size, anchors)
        else:  # Documents are cut into windows with their values only if an item has one.
            kinds = KINDS_OF_WINDOWS if per_item.filter("kind = 2").limit(1).count() else KINDS_OF_WINDOWS[:2]
            candidates = _windows(templates, ["doc_id", "text_hash", "n"], size, kinds).withColumn("pos", F.col("at") % (F.col("n") - (size - 1)))
        hits = candidates.join(small_side(wanted), "hash").select("doc_id", "text_hash", "pos", "hash").distinct()
        hits = save_table(hits, "leak-hits")
        matches = hits.join(per_item, "hash").withColumn("shift", F.col("pos") - F.col("item_pos")).groupBy(
            "doc_id", "text_hash", "class", "shift", "item_pos").agg(F.max("is_template").alias("is_template"))
        of_template = F.when(F.col("is_template"), F.col("item_pos"))
        passages = matches.groupBy("doc_id", "text_hash", "class", "shift").agg(
            F.count_if("is_template").alias("n_templates"), F.min(of_template).alias("first"), (F.max(of_template) + size).alias("end"),
            F.collect_list("item_pos").alias("at")).withColumn("size", F.lit(size))
        part = passages.join(per_class, "class").withColumns({
            "by_template": (F.col("n_templates") > 0) & (F.col("n_templates") >= F.least(F.lit(min_windows), F.col("class_templates"))),
            "enough": F.least(F.lit(min_windows), F.col("class_windows")),
        }).withColumn("by_any", F.size("at") >= F.col("enough")).filter("by_template OR by_any").drop("class_templates", "class_windows")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {docs.select(key).schema[0].dataType.simpleString()}, text_hash bigint, "
            f"item_id {benchmark.select(item).schema[0].dataType.simpleString()}, n_windows bigint, n_slots int, exact boolean")
    passages = save_table(found, "leak-passages")

    # The values of the slots, for documents with a passage only.
    suspects = save_table(passages.select("doc_id", "text_hash").distinct(), "leak-suspects").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = doc_rows.join(small_side(suspects), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "words")
    spans = save_table(passages.join(texts, same).drop("_id", "_hash"), "leak-spans")
    # Windows of a passage that are word for word those of an item of its class.
    def window_at(words: Column, at: Column) -> Column:
        return F.xxhash64(F.slice(words, at + 1, F.col("size")))

    members = item_words.select("class", literal(F.col("words")).alias("lower"), F.least(F.size("template"), F.lit(window)).alias("size"))
    starts = F.transform(F.sequence(F.lit(0), F.size("lower") - F.col("size")), lambda i: window_at(F.col("lower"), i))
    own = members.select("class", F.posexplode(starts).alias("item_pos", "literal")).distinct()
    theirs = spans.withColumn("lower", literal(F.col("words"))).select(
        "doc_id", "text_hash", "class", "shift", F.explode(
            F.transform("at", lambda p: F.struct(p.alias("item_pos"), window_at(F.col("lower"), p + F.col("shift")).alias("literal")))).alias("one"))
    theirs = theirs.select("doc_id", "text_hash", "class", "shift", "one.*")
    # At most one position per window of an item; literal windows that follow each other are one longer literal stretch.
    counts = theirs.join(own, ["class", "item_pos", "literal"]).groupBy("doc_id", "text_hash", "class", "shift").agg(
        F.sort_array(F.collect_set("item_pos")).alias("literal_at"))
    counts = counts.select(*[F.col(c).alias("_" + c) for c in ("doc_id", "text_hash", "class", "shift")], "literal_at")
    spans = spans.join(counts, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
                       & (F.col("class") == F.col("_class")) & (F.col("shift") == F.col("_shift")), "left").drop("_doc_id", "_text_hash", "_class", "_shift")
    spans = spans.withColumn("literal_at", F.coalesce("literal_at", F.array().cast("array<bigint>"))).join(classes.select("class", "item_id", "template", "patterns", F.col("words").alias("item_words")), "class")
    length = F.col("end") - F.col("first")
    aligned = F.arrays_zip(
        F.sequence(F.col("first"), F.col("end") - 1).alias("i"), F.slice("template", F.col("first") + 1, length).alias("kind"), F.slice("item_words", F.col("first") + 1, length).alias("mine"),
        F.slice("words", F.col("first") + F.col("shift") + 1, length).alias("theirs"))
    # Of windows of any kind: the tokens that lie in a matching window, without regard to letter case.
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("size") - 1))))
    caseless_aligned = F.transform(covered, lambda i: F.struct(
        i.alias("i"), F.get("template", i).alias("kind"), F.lower(F.get("item_words", i)).alias("mine"), F.lower(F.get("words", i + F.col("shift"))).alias("theirs")))

    def slots_of(zipped: Column) -> Column:
        return F.filter(zipped, lambda z: z["kind"].isin(NUMBER, NAME, UNIT))

    def consistent(slots: str, field: str) -> Column:
        """Whether the slots map consistently from at least one item of the class."""

        def by_pattern(pattern: Column) -> Column:
            def distinct(kinds: tuple[str, ...], mine: bool, theirs: bool) -> Column:
                fields = lambda z: ([F.get(pattern[field], z["i"])] if mine else []) + ([z["theirs"]] if theirs else [])
                return F.size(F.array_distinct(F.transform(
                    F.filter(slots, lambda z: z["kind"].isin(*kinds)), lambda z: F.struct(z["kind"], *fields(z)))))

            function = distinct((NUMBER, NAME, UNIT), True, True) == distinct((NUMBER, NAME, UNIT), True, False)
            return function & (distinct((NAME,), True, True) == distinct((NAME,), False, True))

        return F.exists("patterns", by_pattern)

    def own_values(slots: str) -> Column:
        return F.size(F.filter(slots, lambda z: z["mine"] != z["theirs"])) == 0

    judged = spans.withColumns({
        "slots": F.when(F.col("by_template"), slots_of(aligned)), "any_slots": F.when(F.col("by_any"), slots_of(caseless_aligned))})
    # Positions ascend, so ``enough`` windows in a row end where the position has grown as much as the index.
    last = F.col("enough").cast("int") - 1
    copied = F.exists(F.transform("literal_at", lambda p, i: F.get("literal_at", i + last) == p + last), lambda in_a_row: F.coalesce(in_a_row, F.lit(False)))
    judged = judged.withColumns({
        "by_template": F.col("by_template") & consistent("slots", "own"),
        "by_any": F.col("by_any") & (copied | consistent("any_slots", "caseless"))}).filter("by_template OR by_any")
    judged = judged.select(
        "doc_id", "text_hash", "item_id", "by_template", F.xxhash64(caseless(F.col("item_words"))).alias("twins"),
        F.when(F.col("by_template"), F.col("n_templates")).otherwise(F.size("at").cast("bigint")).alias("n_windows"),
        F.when(F.col("by_template"), F.size("slots")).otherwise(F.size("any_slots")).alias("n_slots"),
        (F.when(F.col("by_template"), own_values("slots")).otherwise(own_values("any_slots")) | (F.size("literal_at") == F.size("at"))).alias("exact"))
    best = F.max(F.struct("by_template", "n_windows", "n_slots")).alias("best")
    rows = judged.groupBy("doc_id", "text_hash", "item_id", "twins").agg(best, F.max("exact").alias("exact"))
    by_template = F.max("best.by_template").over(Window.partitionBy("doc_id", "text_hash", "twins"))
    return rows.withColumn("twin_by_template", by_template).filter("best.by_template OR NOT twin_by_template").select(
        "doc_id", "text_hash", "item_id", "best.n_windows", "best.n_slots", "exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found, with all their columns."""
    leaks = save_table(find_leaks(docs, benchmark, key, text, **options).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leak-found")
    same = F.col(f"`{key}`").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty(text)) == F.col("_hash"))
    return docs.join(small_side(leaks), same, "left_anti")
