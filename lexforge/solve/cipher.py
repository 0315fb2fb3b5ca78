"""Substitution ciphers: a mapping from examples, grown word by word from a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import let, lines, strip

# The vocabulary.
VOCABULARY = """above alice ancient around beyond bird book bright castle cat cave chases clever colorful creates crystal
curious dark discovers door dragon draws dreams explores follows forest found garden golden hatter hidden imagines in
inside island key king knight library magical map message mirror mountain mouse mysterious near ocean palace potion
princess puzzle queen rabbit reads school secret sees silver story strange student studies teacher the through tower
treasure turtle under valley village watches wise wizard wonderland writes""".split()


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def pattern(word: Column) -> Column:
    """First-occurrence numbers of a word's letters: hello is 1,2,3,3,4."""
    return let(chars(word), lambda cs: let(F.array_distinct(cs), lambda own: F.transform(cs, lambda c: F.array_position(own, c).cast("int"))))


def examples(prompt: Column) -> Column:
    """(cipher, plain) pairs of the lines with an arrow."""
    told = F.filter(F.transform(lines(prompt), strip), lambda x: x.contains("->") & ~F.lower(x).startswith("now, decrypt"))
    pairs = F.transform(told, lambda x: F.struct(strip(F.substring_index(x, "->", 1)).alias("cipher"), strip(F.substr(x, F.instr(x, "->") + 2)).alias("plain")))
    return F.filter(pairs, lambda p: (p["cipher"] != "") & (p["plain"] != ""))


def query(prompt: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(prompt, r"(?is)Now,\s*decrypt\s+the\s+following\s+text:\s*(.+?)\s*$", 1)), F.lit(""))


def mapping(pairs: Column) -> Column:
    """The letter map of example pairs; null if lengths differ, letters conflict or there is none."""
    letters = F.flatten(F.transform(pairs, lambda p: F.filter(F.arrays_zip(chars(p["cipher"]).alias("c"), chars(p["plain"]).alias("p")), lambda z: z["c"].rlike(r"^\p{L}$") & z["p"].rlike(r"^\p{L}$"))))
    aligned = F.forall(pairs, lambda p: F.length(p["cipher"]) == F.length(p["plain"]))

    def of(own: Column) -> Column:
        single = F.size(F.array_distinct(F.transform(own, lambda z: z["c"]))) == F.size(own)
        return F.when(single & (F.size(own) > 0), F.map_from_entries(own))

    return F.when(aligned, let(F.array_sort(F.array_distinct(letters)), of))


def vocabulary_words(words: list[str] = VOCABULARY) -> Column:
    """The words with their letters, in order, by their pattern, as a constant map."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words):
        own = list(dict.fromkeys(w))
        groups.setdefault(",".join(str(own.index(c) + 1) for c in w), []).append(w)
    entry = lambda w: F.struct(F.lit(w).alias("word"), F.array(*map(F.lit, w)).alias("cs"))
    return F.create_map(*[x for key, held in groups.items() for x in (F.lit(key), F.array(*map(entry, held)))])


def fitting(word: Column, known: Column, vocabulary: Column, one_to_one: bool) -> Column:
    """Vocabulary words that a cipher word may stand for under the known letters: those of its pattern, looked up, that agree."""
    def of(w: Column) -> Column:
        def may(v: Column) -> Column:
            def fits(z: Column) -> Column:
                plain = F.try_element_at(known, z["c"])
                free = ~F.array_contains(F.map_values(known), z["p"]) if one_to_one else F.lit(True)
                return F.when(plain.isNotNull(), plain == z["p"]).otherwise(free)

            return F.forall(F.arrays_zip(w["cs"].alias("c"), v["cs"].alias("p")), fits)

        return F.coalesce(F.transform(F.filter(F.try_element_at(vocabulary, w["key"]), may), lambda v: v["word"]), F.array().cast("array<string>"))

    key = F.array_join(F.transform(pattern(word), lambda x: x.cast("string")), ",")
    return let(F.struct(chars(word).alias("cs"), key.alias("key")), of)


STEP = "struct<word:string,partial:string,full:boolean,matches:array<string>,fits:array<string>,chosen:string,added:array<struct<c:string,p:string>>>"


def decode(known: Column, text: Column, vocabulary: Column, steps: bool = False) -> Column:
    """(decoded, unique, mapping): words from left to right, each choice adding its letters to the mapping; with ``steps`` also what was done for each."""
    kind = "map<string,string>"
    none = [F.array().cast(f"array<{STEP}>").alias("steps")] if steps else []
    start = F.struct(F.lit("").alias("decoded"), F.lit(True).alias("unique"), known.cast(kind).alias("map"), *none)

    def step(state: Column, word: Column) -> Column:
        partial = F.array_join(F.transform(chars(word), lambda c: F.coalesce(F.try_element_at(state["map"], c), F.lit("?"))), "")

        def of(part: Column) -> Column:
            full = ~part.contains("?")

            def chosen(words: Column) -> Column:
                pick = F.when(full, part).otherwise(F.coalesce(F.get(words, F.lit(0)), part))
                new = F.array_distinct(F.filter(F.arrays_zip(chars(word).alias("c"), chars(pick).alias("p")), lambda z: (z["p"] != "?") & ~F.map_contains_key(state["map"], z["c"])))
                done = F.struct(word.alias("word"), part.alias("partial"), full.alias("full"), fitting(word, state["map"], vocabulary, False).alias("matches"), words.alias("fits"), pick.alias("chosen"), new.alias("added"))
                return F.struct(
                    strip(F.concat_ws(" ", state["decoded"], pick)).alias("decoded"),
                    (state["unique"] & (full | (F.size(words) == 1))).alias("unique"),
                    F.map_concat(state["map"], F.map_from_entries(new)).cast(kind).alias("map"),
                    *([F.concat(state["steps"], F.array(done.cast(STEP))).alias("steps")] if steps else []),
                )

            return let(fitting(word, state["map"], vocabulary, True), chosen)

        return let(partial, of)

    return F.aggregate(F.filter(F.split(text, r"\s+"), lambda w: w != ""), start, step)


def solve(puzzles: DataFrame, prompt: str = "prompt", words: list[str] = VOCABULARY) -> DataFrame:
    """puzzles with (mapping, query, decoded, unique); null where the prompt is no cipher puzzle."""
    told = puzzles.withColumn("mapping", mapping(examples(F.col(prompt)))).withColumn("query", query(F.col(prompt)))
    done = told.withColumn("_s", F.when(F.col("mapping").isNotNull() & F.col("query").isNotNull(), decode(F.col("mapping"), F.col("query"), vocabulary_words(words))))
    return done.select(*told.columns, F.col("_s.decoded").alias("decoded"), F.col("_s.unique").alias("unique"))
