"""Preference texts as tables: clauses, colour mentions, polarity, constraints and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, text
from ..sources.tables import grown, stored
from .relational import ranked

# Fixed cue lists of the lexical polarity.
POSITIVE_CUES = ("want", "like", "love", "prefer", "looking for", "need", "give me")
NEGATIVE_CUES = ("not", "don't", "dont", "avoid", "without", "no", "exclude")
# Fixed axis words: word, axis, direction.
AXIS_WORDS = (
    ("dim", "brightness", "lower"), ("muted", "saturation", "lower"), ("dusty", "saturation", "lower"), ("saturated", "saturation", "raise"), ("desaturated", "saturation", "lower"),
)
#: Own axis words, in place of a vector classifier of adjectives.
OWN_AXIS_WORDS = (
    ("bright", "brightness", "raise"), ("light", "brightness", "raise"), ("dark", "brightness", "lower"), ("deep", "depth", "raise"), ("vivid", "vibrancy", "raise"), ("vibrant", "vibrancy", "raise"),
    ("neon", "vibrancy", "raise"), ("flashy", "vibrancy", "raise"), ("soft", "saturation", "lower"), ("clear", "clarity", "raise"), ("muddy", "clarity", "lower"), ("dull", "clarity", "lower"),
)
# Fixed degree words.
DEGREES = {"too": "cap", "more": "more", "less": "less"}
#: Own negation words, in place of a parser's negation arcs.
NEGATIONS = ("not", "no", "never", "without", "dont")
CUE_REACH, NEGATION_REACH = 4, 3
STRENGTHS = {"weak": 1, "med": 2, "strong": 3}
# Fixed cut-points by strength, of raising, and of lowering by axis ("": other axes); fixed weights.
RAISE_CUTS = {"strong": 0.70, "med": 0.60, "weak": 0.55}
LOWER_CUTS = {
    "": {"strong": 0.41, "med": 0.46, "weak": 0.52}, "brightness": {"strong": 0.41, "med": 0.46, "weak": 0.52}, "vibrancy": {"strong": 0.58, "med": 0.50, "weak": 0.64},
    "saturation": {"strong": 0.50, "med": 0.56, "weak": 0.62}, "clarity": {"strong": 0.50, "med": 0.56, "weak": 0.62},
}
CUT_WEIGHTS, DISLIKE_WEIGHT = {"weak": 1.0, "med": 2.0, "strong": 3.0}, 1.5
# Fixed level cuts without a calibration, of dimensions in 0..1.
DEFAULT_CUTS = {"light_hsl": (0.35, 0.55, 0.75, 1.0), "sat_hsl": (0.30, 0.50, 0.70, 1.0), "depth": (0.30, 0.50, 0.70, 1.0), "colorfulness": (0.30, 0.50, 0.70, 1.0)}
# Fixed default directions of axes, and the product word that is no colour.
DEFAULT_DIRECTIONS = {"brightness": "lower", "vibrancy": "lower", "saturation": "lower", "depth": "raise", "clarity": "lower"}
PRODUCT = "lipstick"


def _cue_pattern(cues: tuple[str, ...]) -> str:
    edge = r"[\s,.;:!?()]"
    return rf"(?i)(^|{edge})({'|'.join(cues)})($|{edge})"


NEGATIVE, POSITIVE = _cue_pattern(NEGATIVE_CUES), _cue_pattern(POSITIVE_CUES)


def axis_lexicon() -> list[tuple[str, str, str, bool]]:
    """word, axis, direction, compared: the axis words with their comparatives and superlatives."""
    out = []
    for word, axis, direction in (*AXIS_WORDS, *OWN_AXIS_WORDS):
        stem = word + word[-1] if word in ("dim",) else word[:-1] + "i" if word[-1] == "y" else word
        out += [(word, axis, direction, False), (stem + "er", axis, direction, True), (stem + "est", axis, direction, True)]
    return out


def clauses(texts: DataFrame) -> DataFrame:
    """text_id, clause_id, start, clause, elliptical: parts between sentence ends, semicolons, colons, and conjunctions, commas or brackets before a negation."""
    form = r"[.!?;:\n]+|,?\s+but\s+|,\s+(?=(not|no|without)\b)|\s+and\s+(?=(not|no|without)\b)|\((?=not\b)"
    marked = F.regexp_replace("text", form, "\u0001")
    seps = F.regexp_extract_all("text", F.lit(f"({form})"), 1)
    parts = F.split(marked, "\u0001")
    rows = texts.select("text_id", seps.alias("_s"), F.posexplode(parts).alias("_k", "_p"), parts.alias("_all"))
    lead = F.aggregate(F.slice("_all", F.lit(1), F.col("_k")), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("_s", F.lit(1), F.col("_k")), F.lit(0), lambda s, x: s + F.length(x))
    gap = F.length("_p") - F.length(F.ltrim("_p"))
    rows = rows.withColumns({"start": lead + gap, "clause": F.trim("_p")}).where(F.length("clause") >= 2)
    rows = rows.withColumn("clause_id", F.row_number().over(Window.partitionBy("text_id").orderBy("_k")) - 1)
    return rows.select("text_id", "clause_id", "start", "clause", F.lower("clause").rlike(r"^(but )?(not|no) ").alias("elliptical"))


def plain_not(x: Column) -> Column:
    """"(not x)" as ", not x"."""
    return F.regexp_replace(x, r"\s*\(not ([^)]*)\)", ", not $1")


def mentions(texts: DataFrame, aliases: DataFrame, longest: int = 4, by: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """by, start, len, alias, name: the longest aliases of each text from left to right, without overlap.

    aliases (alias, name), a lexicon of bounded size, is broadcast to the word n-grams, so that those that name nothing go
    no further; the greedy choice folds over a text's candidates in order, keeping the next free word. Columns in by that
    hang on others come along without a join.
    """
    words = texts.select(*by, text.tokens(F.col("text")).alias("w"))
    grams = words.select(*by, "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("len")).where(F.size("w") >= F.col("len"))
    grams = grams.select(*by, "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("start"))
    grams = grams.select(*by, "len", "start", F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ").alias("alias"))
    hits = grams.join(F.broadcast(aliases), "alias").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("len")).alias("neg"), "alias", "name"))).alias("c"))
    form = "struct<next:int,out:array<struct<start:int,len:int,alias:string,name:string>>>"
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,len:int,alias:string,name:string>>").alias("out")).cast(form)

    def step(s: Column, x: Column) -> Column:
        took = F.struct((x["start"] - x["neg"]).alias("next"), F.concat(s["out"], F.array(F.struct(x["start"].alias("start"), (-x["neg"]).alias("len"), x["alias"].alias("alias"), x["name"].alias("name")))).alias("out")).cast(form)
        return F.when(x["start"] >= s["next"], took).otherwise(s)

    return hits.select(*by, F.explode(F.aggregate("c", state, step)["out"]).alias("m")).select(*by, "m.*")


def polarity(x: Column) -> Column:
    """LIKE, DISLIKE or UNKNOWN by lexical cues."""
    neg, pos = x.rlike(NEGATIVE), x.rlike(POSITIVE)
    return F.when(neg & ~pos, "DISLIKE").when(pos & ~neg, "LIKE").otherwise("UNKNOWN")


def clause_polarity(mentioned: DataFrame) -> DataFrame:
    """text_id, clause_id, polarity: only likes, only dislikes, else the clause's own cue, else dislike where it is elliptical. Needs polarity, cue, elliptical."""
    g = mentioned.groupBy("text_id", "clause_id").agg(F.max(F.col("polarity") == "LIKE").alias("l"), F.max(F.col("polarity") == "DISLIKE").alias("d"), F.min("cue").alias("cue"), F.max("elliptical").alias("e"))
    return g.select("text_id", "clause_id", F.when(F.col("l") & ~F.col("d"), "LIKE").when(F.col("d") & ~F.col("l"), "DISLIKE").when(F.col("cue") != "UNKNOWN", F.col("cue")).when(F.col("e"), "DISLIKE").otherwise("UNKNOWN").alias("polarity"))


def vector_polarity(df: DataFrame, include: str, exclude: str, like: str, dislike: str, min_sim: float = 0.30, min_margin: float = 0.10) -> DataFrame:
    """df with polarity, of four vectors of a row: of a text that includes the mention and one that excludes it, and of the two requests.

    What the include text prefers the like request by, less what the exclude text prefers the dislike request by, decides; unknown
    if it is under min_margin either way, or no similarity reaches min_sim.
    """
    sims = [stats.cosine(F.col(text), F.col(pole)) for text in (include, exclude) for pole in (like, dislike)]
    df = df.withColumns(dict(zip(("_il", "_id", "_el", "_ed"), sims)))
    score = (F.col("_il") - F.col("_id")) - (F.col("_ed") - F.col("_el"))
    ok = (F.greatest("_il", "_id", "_el", "_ed") >= min_sim) & (F.abs(score) >= min_margin)
    return df.withColumn("polarity", F.when(ok & (score > 0), "LIKE").when(ok, "DISLIKE").otherwise("UNKNOWN")).drop("_il", "_id", "_el", "_ed")


def mention_polarity(cue: Column, elliptical: Column, sentiment: Column | None = None) -> Column:
    """The polarity of a mention: the cue of its clause, else the clause's sentiment (POS or NEG), else dislike where the clause is an elliptical negation."""
    told = F.when(cue != "UNKNOWN", cue)
    felt = F.when(sentiment == "POS", "LIKE").when(sentiment == "NEG", "DISLIKE") if sentiment is not None else F.lit(None).cast("string")
    return F.coalesce(told, felt, F.when(elliptical, "DISLIKE"), F.lit("UNKNOWN"))


def degree_score(negated: Column, compared: Column, degree: Column, intensity: Column | None = None) -> Column:
    """How far a word's wish goes, in 0..1: negated, compared, under a degree word, or its own intensity (0..1, 0 if not given)."""
    own = F.lit(0.0) if intensity is None else intensity
    return F.when(negated, 0.9).when(compared, 0.85).when(degree.isNotNull(), stats.clip(0.9 + own * 0.1, 0, 1)).otherwise(stats.clip(own * 0.35, 0, 1))


def strength_of(score: Column, negated: Column) -> Column:
    """Strong from 0.75 on, medium from 0.35 on; a weak one is medium under a negation."""
    return F.when(score >= 0.75, "strong").when((score >= 0.35) | negated, "med").otherwise("weak")


def extract_constraints(texts: DataFrame, by: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """by, start, axis, direction, strength, evidence, confidence: axis words with cues in the words before them; texts: by, text.

    The first degree word within CUE_REACH words before decides: more keeps the word's direction, less and too
    turn it; without one, a negation within NEGATION_REACH turns it. The evidence is those cues and the word.
    """
    words = text.tokens(F.col("text"))
    seq = texts.select(*by, words.alias("w"), F.posexplode(words).alias("start", "word"))
    lexicon = texts.sparkSession.createDataFrame(axis_lexicon(), "word string, axis string, base string, compared boolean")
    hits = seq.join(F.broadcast(lexicon), "word")  # a fixed table of some fifty rows
    cues = F.create_map(*(F.lit(x) for kv in (DEGREES | dict.fromkeys(NEGATIONS, "neg")).items() for x in kv))
    near = F.transform(F.sequence(F.greatest(F.col("start") - CUE_REACH, F.lit(0)), F.col("start")), lambda i: F.struct(i.alias("i"), F.try_element_at(cues, F.get("w", i)).alias("cue")))
    hits = hits.withColumn("_c", F.filter(near, lambda x: x["cue"].isNotNull() & (x["i"] < F.col("start")) & ((x["cue"] != "neg") | (x["i"] >= F.col("start") - NEGATION_REACH))))
    degree = F.get(F.filter("_c", lambda x: x["cue"] != "neg"), F.lit(0))["cue"]
    hits = hits.withColumns({"_degree": degree, "_neg": F.exists("_c", lambda x: x["cue"] == "neg")})
    flip = F.when(F.col("base") == "raise", "lower").otherwise("raise")
    direction = F.when(F.col("_degree") == "more", F.col("base")).when(F.col("_degree").isNotNull() | F.col("_neg"), flip).otherwise(F.col("base"))
    score = degree_score(F.col("_neg"), F.col("compared"), F.col("_degree"))
    evidence = F.array_join(F.concat(F.transform("_c", lambda x: F.get("w", x["i"])), F.array("word")), " ")
    return hits.select(*by, "start", "axis", direction.alias("direction"), strength_of(score, F.col("_neg")).alias("strength"), evidence.alias("evidence"), F.lit(1.0).alias("confidence"))


def quality_label(gate: Column, confidence: Column, margin: Column) -> Column:
    """high, med or low: how well a constraint's axis is founded."""
    sure = F.upper(gate).isin("STRICT", "LEXICON")
    return F.when(sure & (confidence >= 0.50) & (margin >= 0.10), "high").when(sure | ((confidence >= 0.45) & (margin >= 0.05)), "med").otherwise("low")


def normalise_constraints(df: DataFrame) -> DataFrame:
    """Constraints as a whole contract: rows without axis go; other directions than lower and raise become the axis's default, other strengths medium; confidence is held to 0..1, evidence is trimmed. defaulted names what was filled in."""
    from .constraints import lookup

    no_direction, no_strength = ~F.coalesce(F.col("direction").isin("lower", "raise"), F.lit(False)), ~F.coalesce(F.col("strength").isin(*STRENGTHS), F.lit(False))
    default = F.coalesce(lookup(DEFAULT_DIRECTIONS, F.col("axis")), F.lit("lower"))
    evidence = F.coalesce(F.trim("evidence"), F.lit(""))
    told = F.array_compact(F.array(F.when(no_direction, "direction"), F.when(no_strength, "strength"), F.when(evidence == "", "evidence")))
    return df.where("axis is not null").withColumns({
        "defaulted": told, "direction": F.when(no_direction, default).otherwise(F.col("direction")), "strength": F.when(no_strength, "med").otherwise(F.col("strength")),
        "confidence": stats.clamp01(F.col("confidence").cast("double")), "evidence": evidence,
    })


def _strength(name: str = "strength") -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STRENGTHS.items() for x in kv)), F.col(name))


def merge_constraints(df: DataFrame, by: tuple[str, ...] = ("text_id", "axis", "direction", "clause_id")) -> DataFrame:
    """One constraint for each key: largest confidence and strength, distinct evidences in order; other columns of the best row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "evidence"))), lambda x: F.trim(x["evidence"]))
    evidence = F.array_join(F.array_distinct(F.filter(parts, lambda e: e != "")), " / ")
    return df.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.max_by("strength", _strength()).alias("strength"), evidence.alias("evidence"), F.min("start").alias("start"))


def resolve_conflicts(df: DataFrame) -> DataFrame:
    """Constraints with status kept, conflict or duplicate, and normalised: the strongest, then most confident of a text's axis stays.

    A raise in a disliked clause is a lower first: normalised tells cap_guard where the evidence has "too",
    else invert_dislike_raise.
    """
    flip = (F.col("polarity") == "DISLIKE") & (F.col("direction") == "raise")
    how = F.when(flip, F.when(F.lower("evidence").contains("too "), "cap_guard").otherwise("invert_dislike_raise"))
    df = df.withColumns({"normalised": how, "direction": F.when(flip, "lower").otherwise(F.col("direction"))})
    over = Window.partitionBy("text_id", "axis")
    df = ranked(df, ["text_id", "axis"], [_strength().desc(), F.desc_nulls_last("confidence"), "clause_id", "start"], "_n")
    both = F.size(F.collect_set("direction").over(over)) > 1
    return df.withColumn("status", F.when(F.col("_n") == 1, "kept").when(both, "conflict").otherwise("duplicate")).drop("_n")


def merge_intents(intents: DataFrame) -> DataFrame:
    """text_id, axis, score, direction, strength, conflict, has_dislike: the signed sum of strengths decides; a tie has no direction. Strength is the largest of the winning side; polarity, where given, does not vote."""
    sign = F.when(F.col("direction") == "raise", 1).otherwise(-1)
    disliked = F.max(F.col("polarity") == "DISLIKE") if "polarity" in intents.columns else F.lit(False)
    g = intents.groupBy("text_id", "axis").agg(F.sum(_strength() * sign).alias("score"), F.max(F.when(sign > 0, _strength())).alias("up"), F.max(F.when(sign < 0, _strength())).alias("down"), F.coalesce(disliked, F.lit(False)).alias("has_dislike"))
    names = F.create_map(*(x for k, v in STRENGTHS.items() for x in (F.lit(v), F.lit(k))))
    direction = F.when(F.col("score") > 0, "raise").when(F.col("score") < 0, "lower")
    won = F.when(F.col("score") > 0, F.col("up")).when(F.col("score") < 0, F.col("down"))
    return g.select("text_id", "axis", "score", direction.alias("direction"), F.try_element_at(names, won).alias("strength"), (F.col("up").isNotNull() & F.col("down").isNotNull()).alias("conflict"), "has_dislike")


def decision_thresholds(decisions: DataFrame) -> DataFrame:
    """Cut-point (cut) and weight of each decision; the cut-points of lowering hang on the axis, and a dislike weighs half as much again."""
    from .constraints import lookup

    lower = {(a, s): v for a, cuts in LOWER_CUTS.items() for s, v in cuts.items()}
    axis = F.when(F.col("axis").isin(*filter(None, LOWER_CUTS)), F.col("axis")).otherwise("")
    cut = F.when(F.col("direction") == "raise", lookup(RAISE_CUTS, F.col("strength"))).otherwise(lookup(lower, axis, F.col("strength")))
    weight = lookup(CUT_WEIGHTS, F.col("strength")) * F.when(F.col("has_dislike"), DISLIKE_WEIGHT).otherwise(1.0)
    return decisions.where("direction is not null and strength is not null").withColumns({"cut": cut, "weight": weight})


def snapped_level(cut: Column, op: Column, cuts: Column) -> Column:
    """The level of ascending cuts (low, medium, high, very_high) for a cut-point in 0..1; NULL without cuts.

    A floor (>=) takes the first level at or above it, else the highest; a cap (<=) the last at or below it,
    else the lowest. Cuts beyond 0..1 are met by rank: the cut-point is a share of the way through them.
    """
    from ..sources.calibration import LEVELS

    n = F.size(cuts)
    unit = (F.element_at(cuts, 1) >= 0) & (F.element_at(cuts, -1) <= 1)
    below, up_to = F.size(F.filter(cuts, lambda x: x < cut)), F.size(F.filter(cuts, lambda x: x <= cut))
    rank = stats.clip(cut, 0, 1) * (n - 1)
    nearly = F.abs(rank - F.floor(rank)) < 1e-12
    at = F.when(unit & (op == ">="), below).when(unit, up_to - 1).when((op == ">=") & ~nearly, F.floor(rank) + 1).otherwise(F.floor(rank))
    return F.when(n > 0, F.element_at(F.array(*map(F.lit, LEVELS)), (F.least(F.greatest(at, F.lit(0)), n - 1) + 1).cast("int")))


def constraint_blobs(thresholds: DataFrame, cuts: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """text_id, constraints: the decisions as a constraint string, by axis; cut-points snap to the levels of cuts (dim: ascending thresholds), by default the fixed cuts of dimensions in 0..1. Dimensions without cuts are left out."""
    from .constraints import AXIS_DIM, lookup

    table = F.create_map(*(x for d, v in (DEFAULT_CUTS if cuts is None else cuts).items() for x in (F.lit(d), F.array(*map(F.lit, sorted(v))))))
    op = F.when(F.col("direction") == "raise", ">=").otherwise("<=")
    rows = thresholds.withColumn("_dim", lookup(AXIS_DIM, F.col("axis"))).withColumn("_level", snapped_level(F.col("cut"), op, F.try_element_at(table, F.col("_dim"))))
    weight = F.regexp_replace(F.format_string("%.6f", "weight"), r"\.?0+$", "")
    rows = rows.where("_level is not null").select("text_id", "axis", F.concat("_dim", op, "_level", F.lit(":"), weight).alias("p"))
    return rows.groupBy("text_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("axis", "p"))), lambda x: x["p"]), ";").alias("constraints"))


def style_intents(parts: DataFrame, colour_words: DataFrame, stop_words: DataFrame) -> DataFrame:
    """text_id, label, n, strength, source of clauses (text_id, clause, elliptical): words used at least twice in a text, as shares of its most used one.

    GLOBAL: words of all clauses that are no colour words (word); ELLIPTICAL_NEG: words of elliptical
    negations. Words under three letters, numbers, stop words (word) and the product are left out.
    """
    bare = F.regexp_replace("label", "(es|s)$", "")
    words = parts.select("text_id", "elliptical", F.explode(text.tokens(F.col("clause"))).alias("label")).where((F.length("label") >= 3) & ~F.col("label").rlike(r"^\d+$") & (F.col("label") != PRODUCT) & (bare != PRODUCT))
    words = words.join(stop_words.select(F.col("word").alias("label")), "label", "left_anti")
    rows = words.join(colour_words.select(F.col("word").alias("label")), "label", "left_anti").withColumn("source", F.lit("GLOBAL")).unionByName(words.where("elliptical").withColumn("source", F.lit("ELLIPTICAL_NEG")))
    n = rows.groupBy("text_id", "source", "label").agg(F.count("*").alias("n")).where("n >= 2")
    return n.withColumn("strength", F.col("n") / F.max("n").over(Window.partitionBy("text_id", "source"))).select("text_id", "label", "n", "strength", "source")


def elliptical_labels(parts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """text_id, labels: the distinct words of a text's elliptical negations, in order."""
    words = parts.where("elliptical").select("text_id", "clause_id", F.posexplode(text.tokens(F.col("clause"))).alias("pos", "word")).where((F.length("word") >= 3) & ~F.col("word").rlike(r"^\d+$") & (F.regexp_replace("word", "(es|s)$", "") != PRODUCT))
    words = words.join(stop_words.select("word"), "word", "left_anti")
    return words.groupBy("text_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "pos", "word"))), lambda x: x["word"])).alias("labels"))


def taste(mentioned: DataFrame) -> DataFrame:
    """text_id, likes, dislikes of mentions (text_id, clause_id, start, name, alias, hue_deg, polarity): arrays of (family, hue_deg, alias) in order; texts without either are left out."""
    item = F.struct("clause_id", "start", F.struct(F.col("name").alias("family"), "hue_deg", "alias").alias("item"))
    of = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, item))), lambda x: x["item"])
    return mentioned.where(F.col("polarity").isin("LIKE", "DISLIKE")).groupBy("text_id").agg(of("LIKE").alias("likes"), of("DISLIKE").alias("dislikes"))


def semantic_top(df: DataFrame, keys: DataFrame, k: int = 5, first: float = 0.62, keep: float = 0.55) -> DataFrame:
    """The k most similar keys of each vector, if the best reaches `first`; those that reach `keep`. keys (key_id, key) is a lexicon of bounded size."""
    j = df.crossJoin(F.broadcast(keys)).withColumn("sim", stats.cosine(F.col("embedding"), F.col("key")))
    j = ranked(j, ["vec_id"], [F.desc_nulls_last("sim"), "key_id"]).where(F.col("rank") <= k)
    return j.withColumn("_best", F.max("sim").over(Window.partitionBy("vec_id"))).where((F.col("_best") >= first) & (F.col("sim") >= keep)).select("vec_id", "key_id", "sim", "rank")


def classify_axes(labels: DataFrame, descriptions: DataFrame, least: float = 0.35, margin: float = 0.08) -> DataFrame:
    """vec_id, axis, best, margin: the axis of the most similar description, NULL where similarity or margin to the second axis is small."""
    j = labels.crossJoin(F.broadcast(descriptions)).groupBy("vec_id", "axis").agg(F.max(stats.cosine(F.col("embedding"), F.col("key"))).alias("sim"))
    g = j.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("sim", "axis")), asc=False).alias("s"))
    gap = F.col("s")[0]["sim"] - F.coalesce(F.get("s", F.lit(1))["sim"], F.lit(0.0))
    return g.select("vec_id", F.when((F.col("s")[0]["sim"] >= least) & (gap >= margin), F.col("s")[0]["axis"]).alias("axis"), F.col("s")[0]["sim"].alias("best"), gap.alias("margin"))


def break_ties(classified: DataFrame, labels: DataFrame, probes: DataFrame, least: float = 0.35, margin: float = 0.08, clear: float = 0.02) -> DataFrame:
    """vec_id, axis of ranked axes (vec_id, s: array of struct<sim, axis>, best first): close calls between two axes go to the probe that is nearer, if by `clear`.

    labels: vec_id, embedding; probes: a fixed list of vectors, pair (the two axes in order, joined by |), axis, key.
    """
    top = classified.select("vec_id", F.col("s")[0]["axis"].alias("a1"), F.col("s")[0]["sim"].alias("s1"), F.get("s", F.lit(1))["axis"].alias("a2"), F.round(F.col("s")[0]["sim"] - F.coalesce(F.get("s", F.lit(1))["sim"], F.lit(-1.0)), 9).alias("gap"))
    close = top.where((F.col("s1") >= least) & (F.col("gap") < margin)).withColumn("pair", F.array_join(F.sort_array(F.array("a1", "a2")), "|"))
    asked = close.join(labels, "vec_id").join(probes, "pair").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct(stats.cosine(F.col("embedding"), F.col("key")).alias("sim"), "axis")), asc=False).alias("p"))
    asked = asked.select("vec_id", F.when(F.round(F.col("p")[0]["sim"] - F.get("p", F.lit(1))["sim"], 9) >= clear, F.col("p")[0]["axis"]).alias("_told"))
    return top.join(asked, "vec_id", "left").select("vec_id", F.coalesce("_told", F.when((F.col("s1") >= least) & (F.col("gap") >= margin), F.col("a1"))).alias("axis"), F.col("_told").isNotNull().alias("probed"))


def vote_axes(ranked_axes: DataFrame, variants: DataFrame, topk: int = 3) -> DataFrame:
    """label, axis, score: weighted_vote over the topk axes of each label's variants; ranked_axes: label, axis, score; variants: label, variant, weight."""
    best = ranked(ranked_axes, ["label"], [F.desc(F.round("score", 9)), "axis"], "_k").where(F.col("_k") <= topk)
    lists = best.groupBy(F.col("label").alias("variant")).agg(F.collect_list(F.struct("axis", "score")).alias("axes"))
    return weighted_vote(variants.where("weight > 0").join(grown(lists), "variant"))


def choose_axes(ranked_axes: DataFrame, votes: DataFrame, least: float = 0.35, margin: float = 0.08) -> DataFrame:
    """label, axis, source: the label's own best axis where it is similar enough and clear (classifier), else its variants' vote where that is (vote), else its best axis if similar enough (raw, ambiguous)."""

    def top(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("m"), "axis"))).alias("l"))
        gap = F.round(F.coalesce(F.get("l", F.lit(1))["m"], F.lit(0.0)) - F.col("l")[0]["m"], 9)
        return g.select("label", F.struct(F.col("l")[0]["axis"].alias("axis"), (-F.col("l")[0]["m"] >= least).alias("near"), (gap >= margin).alias("clear")).alias(name))

    j = top(ranked_axes, "_o").join(grown(top(votes, "_v")), "label", "left")
    sure = lambda c: F.coalesce(F.col(f"{c}.near") & F.col(f"{c}.clear"), F.lit(False))
    source = F.when(sure("_o"), "classifier").when(sure("_v"), "vote").when(F.col("_o.near"), "raw")
    return j.select("label", F.when(source == "vote", F.col("_v.axis")).when(source.isNotNull(), F.col("_o.axis")).alias("axis"), source.alias("source"))


def weighted_vote(ranked_axes: DataFrame) -> DataFrame:
    """label, axis, score: weighted mean score of each axis over a label's variants (weight, axes array of struct<axis, score>)."""
    e = ranked_axes.select("label", "weight", F.explode("axes").alias("x"))
    return e.groupBy("label", F.col("x.axis").alias("axis")).agg(F.try_divide(F.sum(F.col("weight") * F.col("x.score")), F.sum("weight")).alias("score"))


def interpreted(texts: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clauses, mentions, constraints) of texts (text_id, text): all steps from clauses to resolved constraints.

    clauses: with polarity; mentions: text_id, clause_id, start, len, alias, name, polarity (places in words
    of the clause); constraints: merged by clause, normalised and resolved, with the clause's polarity and status.
    """
    parts = stored(clauses(texts.select("text_id", plain_not(F.col("text")).alias("text"))).withColumn("cue", polarity(F.col("clause"))), "clauses")
    key = ("text_id", "clause_id")
    found = mentions(parts.select(*key, "cue", "elliptical", F.col("clause").alias("text")), aliases, by=(*key, "cue", "elliptical"))
    found = stored(found.withColumn("polarity", mention_polarity(F.col("cue"), F.col("elliptical"))), "mentions")
    told = parts.select(*key, F.lit("UNKNOWN").alias("polarity"), "cue", "elliptical").unionByName(found.select(*key, "polarity", "cue", "elliptical"))
    parts = parts.join(grown(clause_polarity(told)), list(key))
    held = (*key, "polarity")
    cons = merge_constraints(extract_constraints(parts.select(*held, F.col("clause").alias("text")), held), (*held, "axis", "direction"))
    return parts, found.drop("cue", "elliptical"), resolve_conflicts(normalise_constraints(cons))


def interpret(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """text_id, clauses, mentions, constraints, suppressed: one row for each text, arrays in order; to_json gives its nested output."""
    parts, found, cons = interpreted(texts, aliases)
    listed = lambda df, name, *fields: df.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    of = ("clause_id", "start", "axis", "direction", "strength", "evidence", "confidence", "polarity")
    rows = (
        listed(parts, "clauses", "clause_id", "start", "clause", "elliptical", "polarity"),
        listed(found, "mentions", "clause_id", "start", "len", "name", "polarity"),
        listed(cons.where("status = 'kept'"), "constraints", *of),
        listed(cons.where("status <> 'kept'"), "suppressed", *of, "status"),
    )
    out = texts.select("text_id")
    for df in rows:
        out = out.join(grown(df), "text_id", "left")
    return out


def primary_targets(mentioned: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The one safe target of each group: colours and finishes first, then confidence, then place; none if the second is of the same rank and within 0.10 of its confidence."""
    rank = F.when(F.col("kind").isin("color", "finish"), 0).otherwise(1)
    sure = F.coalesce("confidence", F.lit(0.0))
    over = Window.partitionBy(*by).orderBy(rank, sure.desc(), "start", "stop")
    m = mentioned.withColumns({"_n": F.row_number().over(over), "_k": F.lead(rank).over(over), "_c": F.lead(sure).over(over)})
    tie = F.coalesce((F.col("_k") == rank) & (F.abs(sure - F.col("_c")) < 0.10), F.lit(False))
    return m.where((F.col("_n") == 1) & ~tie).drop("_n", "_k", "_c")


def _group() -> Column:
    return F.when(F.col("polarity") == "LIKE", 0).when(F.col("polarity") == "DISLIKE", 2).otherwise(1)


def _safe_targets(mentioned: DataFrame) -> DataFrame:
    """text_id, clause_id, _t: the clause's safe target with its bucket; of the liked, else of the neutral, else of the disliked mentions."""
    m = primary_targets(mentioned.withColumn("_g", _group()), ("text_id", "clause_id", "_g"))
    bucket = F.when(F.col("_g") == 0, "liked").otherwise("disliked")
    return m.groupBy("text_id", "clause_id").agg(F.min_by(F.struct(bucket.alias("bucket"), "start", "stop", "name", "kind"), "_g").alias("_t"))


def resolve_targets(mentioned: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, unattached constraints) of mentions (text_id, clause_id, start, stop, name, kind, polarity, confidence) and constraints (text_id, clause_id, ...).

    targets: text_id, bucket, start, stop, name, kind, n_constraints. A clause's constraints go to its
    safe target: of the liked, else of the neutral, else of the disliked mentions; a neutral target
    stands in the disliked bucket. Constraints of clauses without a safe target stay global.
    """
    of = ("start", "stop", "name", "kind")
    bucket = F.when(F.col("_g") == 0, "liked").otherwise("disliked")
    m = mentioned.withColumn("_g", _group())
    scoped = constraints.join(grown(_safe_targets(mentioned)), ["text_id", "clause_id"], "left")
    told = m.where("_g <> 1").select("text_id", bucket.alias("bucket"), *of, F.lit(0).cast("long").alias("n"))
    held = scoped.where("_t is not null").select("text_id", "_t.*", F.lit(1).cast("long").alias("n"))
    targets = told.unionByName(held).groupBy("text_id", "bucket", *of).agg(F.sum("n").alias("n_constraints"))
    return targets, scoped.where("_t is null").drop("_t")


def project_axes(mentioned: DataFrame, constraints: DataFrame) -> DataFrame:
    """text_id, axis, direction, strength, polarity, source: an intent for each constraint, attached to a safe target or global.

    The polarity is that of the constraint's clause (polarity); where that is unknown, of its target's bucket,
    and LIKE for global ones. Constraints: text_id, clause_id, axis, direction, strength, polarity.
    """
    safe = grown(_safe_targets(mentioned))
    j = constraints.join(safe, ["text_id", "clause_id"], "left")
    bucket = F.when(F.col("_t.bucket") == "disliked", "DISLIKE").otherwise("LIKE")
    known = F.when(F.col("polarity").isin("LIKE", "DISLIKE", "NEUTRAL"), F.col("polarity")).otherwise(bucket)
    return j.select("text_id", "axis", "direction", "strength", known.alias("polarity"), F.when(F.col("_t").isNull(), "global").otherwise("target").alias("source"))


def axis_family(scores: DataFrame, by: str) -> DataFrame:
    """by, axis, family: the family of the axis that scores best (then the smaller name); NULL for an axis of no family."""
    top = scores.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("axis"))).alias("t"))
    # fixed families
    family = F.when(F.col("t.axis") == "depth", "DEPTH").when(F.col("t.axis") == "brightness", "LIGHTNESS").when(F.col("t.axis") == "clarity", "SURFACE").when(F.col("t.axis").isin("saturation", "vibrancy"), "CHROMA")
    return top.select(by, F.col("t.axis").alias("axis"), family.alias("family"))


def filter_variants(variants: DataFrame, labels: DataFrame, least: float = 0.75) -> DataFrame:
    """label, variant, weight: variants (label, variant, embedding) as similar to their label (label, key) as `least`, with that similarity; the label itself weighs 1."""
    near = variants.where("variant <> label").join(labels, "label").select("label", "variant", stats.cosine(F.col("embedding"), F.col("key")).alias("weight"))
    return near.where(F.round("weight", 9) >= least).unionByName(labels.select("label", F.col("label").alias("variant"), F.lit(1.0).alias("weight")))


def gate_axes(scores: DataFrame, by: str, least: float = 0.35, margin: float = 0.08, colour: bool = True) -> DataFrame:
    """by, axis, gate of axis scores (by, axis, score): the best axis if it is similar enough and clear of the second.

    Else, if the first two are of one family (lightness or chroma), the first, or for chroma a lightness
    axis among the first three that is within 0.03 of it; in colour contexts a margin under 0.02 is too flat.
    """
    # fixed families
    family = lambda a: F.when(a.isin("brightness", "depth"), "LIGHTNESS").when(a.isin("saturation", "vibrancy"), "CHROMA").otherwise("OTHER")
    g = scores.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "axis"))).alias("s"))
    top, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    g = g.select(by, top["axis"].alias("a1"), (-top["neg"]).alias("s1"), second["axis"].alias("a2"), F.round(F.coalesce(second["neg"], F.lit(0.0)) - top["neg"], 9).alias("gap"), F.slice("s", 1, 3).alias("s"))
    light = F.get(F.filter("s", lambda x: family(x["axis"]) == "LIGHTNESS"), F.lit(0))
    biased = F.when(F.round(F.col("s1") + light["neg"], 9) <= 0.03, light["axis"])
    same = (family(F.col("a1")) == family(F.col("a2"))) & (family(F.col("a1")) != "OTHER")
    bias = (family(F.col("a1")) == "CHROMA") & biased.isNotNull()
    gate = F.when(F.col("s1") < least, "min_sim").when(F.col("gap") >= margin, "strict").when(F.col("a2").isNull(), "no_ranked").when(F.col("gap") < (0.02 if colour else 0.0), "too_flat").when(same & bias, "family_bias_lightness").when(same, "family").otherwise("fail_family")
    axis = F.when(gate.isin("strict", "family"), F.col("a1")).when(gate == "family_bias_lightness", biased)
    return g.select(by, axis.alias("axis"), gate.alias("gate"))
