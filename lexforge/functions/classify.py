"""Puzzle categories, types, subtypes and eligibility, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.text import first_filled, let, lines, map_lookup, strip

# The categories' first sentences.
CATEGORY_OF_SENTENCE = {
    "In Alice's Wonderland, a secret bit manipulation rule transforms 8-bit binary numbers.": "Bit Manipulation",
    "In Alice's Wonderland, the gravitational constant has been secretly changed.": "Gravity",
    "In Alice's Wonderland, a secret unit conversion is applied to measurements.": "Unit Conversion",
    "In Alice's Wonderland, secret encryption rules are used on text.": "Text Cipher",
    "In Alice's Wonderland, numbers are secretly converted into a different numeral system.": "Numeral System",
    "In Alice's Wonderland, a secret set of transformation rules is applied to equations.": "Transformation Rules",
}
BASE_CATEGORIES = tuple(CATEGORY_OF_SENTENCE.values())
# Type slugs with their category.
CATEGORY_OF_TYPE = {
    "bit_manipulation": "Bit Manipulation",
    "gravity": "Gravity",
    "unit_conversion": "Unit Conversion",
    "text_cipher": "Text Cipher",
    "numeral_system": "Numeral System",
    "numeric_equation": "Numeric Equation Transformation Rules",
    "symbol_transform": "Symbol Transform",
}
TYPE_OF_CATEGORY = {c: t for t, c in CATEGORY_OF_TYPE.items()}
# Short names of types.
TYPE_ALIASES = {
    "bit": "bit_manipulation", "unit": "unit_conversion", "text": "text_cipher", "cipher": "text_cipher",
    "numeral": "numeral_system", "numeric": "numeric_equation",
    "numeric_equation_transformation_rules": "numeric_equation", "symbol": "symbol_transform",
    "symbol_equation": "symbol_transform",
}
# Source modes that only train.
TRAIN_ONLY_MODES = (
    "huikang_real_bit_extra_trace", "huikang_synthetic_matching", "phase1_synthetic_direct_template",
    "single_phase_synthetic_direct_template", "single_phase_synthetic_text_cipher_confusion", "synthetic",
)
# Path markers, first to last.
SOURCE_MARKERS = ("work_on", "synthetic", "numeric_equation_transformation", "symbol_transform")
FALSE_WORDS = ("0", "false", "no", "n", "off")
SPLITS = ("sft_train", "eval_holdout", "grpo_holdout")


def first_sentence(prompt: Column) -> Column:
    flat = strip(F.regexp_replace(prompt, r"\s+", " "))
    return let(flat, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"^(.+?[.!?])(?:\s|$)", 1), F.lit("")), t))


def category(prompt: Column, strict: bool = True) -> Column:
    """The category of a prompt; of an unknown template an error, or null where not strict."""
    found = map_lookup(first_sentence(prompt), CATEGORY_OF_SENTENCE)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no category for a prompt that begins: "), first_sentence(prompt)))) if strict else found


def question_type(name: Column) -> Column:
    """A type slug from its name or an alias; null if there is none."""
    slug = F.regexp_replace(F.lower(strip(name)), "[- ]", "_")
    known = F.coalesce(map_lookup(slug, TYPE_ALIASES), slug)
    return F.when(known.isin(*CATEGORY_OF_TYPE), known)


def safe_label(text: Column) -> Column:
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"\|", "_"), r"\+", "plus"), "-", "minus")
    clean = F.btrim(F.regexp_replace(named, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def slugify(text: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def source_key(source: Column) -> Column:
    """What follows the first marker in a source path, without a file name; else the fragment; else the source."""
    source = F.coalesce(source, F.lit(""))

    def after(parts: Column, marker: str) -> Column:
        at = F.array_position(parts, marker).cast("int")
        tail = F.slice(parts, at + 1, F.lit(1 << 30))
        named = F.when(F.coalesce(F.try_element_at(tail, F.lit(-1)).contains("."), F.lit(False)), F.slice(tail, F.lit(1), F.size(tail) - 1)).otherwise(tail)
        return F.when(at > 0, F.coalesce(F.nullif(F.array_join(named, "/"), F.lit("")), F.lit(marker)))

    whole = F.when(source.contains("#"), F.substr(source, F.instr(source, "#") + 1)).otherwise(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")))
    # Only what stands before the first # is a path; every fragment after it is one part.
    pieces = F.split(F.regexp_replace(source, r"\\", "/"), "#")
    parts = let(pieces, lambda x: F.concat(F.split(F.get(x, F.lit(0)), "/"), F.slice(x, F.lit(2), F.size(x))))
    return let(parts, lambda parts: F.coalesce(*[after(parts, m) for m in SOURCE_MARKERS], whole))


def template_pass(text: Column) -> Column:
    """The template that a trace says passes: a fold over its lines that remembers the template being tried."""

    def step(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(F.lower(strip(raw)), " ", "")
        said = F.regexp_extract(line, "^(template(?:0134|3401))passesallexamples$", 1)
        tried = F.regexp_extract(line, "^try(template(?:0134|3401))$", 1)
        found = F.when(state["found"] != "", state["found"]).when(said != "", said).when((line == "pass") & (state["tried"] != ""), state["tried"]).otherwise("")
        now = F.when(tried != "", tried).when(line.startswith("try") & ~line.contains("template"), "").otherwise(state["tried"])
        return F.struct(now.alias("tried"), found.alias("found"))

    start = F.struct(F.lit("").alias("tried"), F.lit("").alias("found"))
    return F.nullif(F.aggregate(lines(F.coalesce(text, F.lit(""))), start, step, lambda s: s["found"]), F.lit(""))


def _two_parts(key: Column) -> Column:
    labels = F.transform(F.filter(F.split(key, "/"), lambda p: p != ""), safe_label)
    return F.array_join(F.slice(labels, 1, 2), "_")


def numeric_subtype(source: Column, trace: Column) -> Column:
    def of(key: Column) -> Column:
        second = F.get(F.split(key, "/"), F.lit(1))
        return (
            F.when(key.contains("direct_template"), F.concat(F.lit("direct_template_"), F.coalesce(template_pass(trace), F.lit("unknown"))))
            .when(key.contains("operator_absence"), "operator_absence")
            .when(key.contains("prefix_postfix"), F.when(F.coalesce(second, F.lit("")) != "", F.concat(F.lit("prefix_postfix_"), safe_label(second))).otherwise("prefix_postfix"))
            .when(key.rlike("^modular(?:/|$)"), "modular")
            .when(key.contains("low_confidence") | key.rlike(r"^(?:ba_dc|ab_cd)_(?:multiplication|addition|subtraction|modular)(?:/|$)"), _two_parts(key))
            .otherwise(safe_label(key))
        )

    return let(F.regexp_replace(F.lower(source_key(source)), "^synthetic/", ""), of)


def symbol_subtype(source: Column, trace: Column) -> Column:
    def of(key: Column) -> Column:
        named = F.concat(F.lit("direct_template_"), F.coalesce(template_pass(trace), F.lit("unknown")))
        return F.when(key.contains("ba_dc"), "ba_dc").when(key.contains("direct_template"), named).otherwise(safe_label(key))

    return let(F.lower(source_key(source)), of)


def bit_subtype(mode: Column) -> Column:
    # Subtypes of source modes.
    named = {
        "huikang_real_bit": "huikang_real_rule_found",
        "huikang_real_bit_extra_trace": "huikang_real_extra_trace",
        "huikang_synthetic_matching": "huikang_synthetic_matching",
        "synthetic": "huikang_synthetic_legacy",
    }
    return F.coalesce(map_lookup(mode, named), safe_label(F.coalesce(mode, F.lit(""))))


def subtype(category: Column, source: Column, mode: Column, trace: Column) -> Column:
    category = F.coalesce(category, F.lit(""))
    return (
        F.when(category == "Numeric Equation Transformation Rules", numeric_subtype(source, trace))
        .when(category == "Symbol Transform", symbol_subtype(source, trace))
        .when(category == "Bit Manipulation", bit_subtype(mode))
        .when(category.isin("Gravity", "Unit Conversion", "Numeral System", "Text Cipher"), "standard")
        .otherwise(safe_label(category))
    )


def eval_eligible(mode: Column, flag: Column) -> Column:
    """Rows that may be held out: not of a train-only mode, and not flagged false (no flag counts as true)."""
    said = F.lower(strip(F.coalesce(flag, F.lit(""))))
    return ~F.coalesce(mode, F.lit("")).isin(*TRAIN_ONLY_MODES) & ~said.isin(*FALSE_WORDS)


def train_only(mode: Column, flag: Column, policy: Column) -> Column:
    return ~eval_eligible(mode, flag) | (strip(F.coalesce(policy, F.lit(""))) == "train_only")


def row_category(meta_category: Column, label: Column, own: Column) -> Column:
    return F.coalesce(first_filled(meta_category, label, own), F.lit("unknown"))


def equation_or_symbol(prompt: Column, query: str = r"(?i)determine the result for:\s*([^\n]+)") -> Column:
    """numeric_equation, symbol_transform or unknown, by the characters of the expression asked for."""
    text = strip(prompt)
    expr = let(F.regexp_extract(text, query, 1), lambda q: F.when(q != "", strip(q)).otherwise(text))

    def count(x: Column, keep: str) -> Column:
        return F.length(F.regexp_replace(x, keep, ""))

    def of(x: Column) -> Column:
        signs, digits, letters = count(x, r"[\w\s]"), count(x, r"[^0-9]"), count(x, r"[^A-Za-z]")
        return (
            F.when(x.rlike(r"\d+\s*[^0-9\s]\s*\d+"), "numeric_equation")
            .when((2 * signs > F.greatest(F.length(x), F.lit(1))) & (digits + letters < F.greatest(F.lit(2), F.floor(signs / 2))), "symbol_transform")
            .when(text.rlike(r"(?m)^\s*\d+[^=\n]*="), "numeric_equation")
            .when(text.rlike(r"[^\w\s]{2,}"), "symbol_transform")
            .otherwise("unknown")
        )

    return let(expr, of)
