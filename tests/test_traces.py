"""Trace texts against plain string building."""

from pyspark.sql import functions as F

from lexforge.solve import cipher, numeric, traces


def plain_cipher(prompt_pairs, query, words):
    """Words from left to right, as the trace tells it."""
    known = {}
    for c, p in prompt_pairs:
        known |= {a: b for a, b in zip(c, p) if a != " "}
    form = lambda w: [w.index(x) for x in w]
    lines = [traces.CIPHER_HEAD, traces.CIPHER_MAP + ", ".join(f"{a}→{b}" for a, b in sorted(known.items())), *traces.CIPHER_METHOD, f'S3: Target text: "{query}"', "S4: Decode target words:"]
    out = []
    shown = lambda ws: "none" if not ws else ", ".join(ws) if len(ws) <= 12 else ", ".join(ws[:12]) + f", ... ({len(ws)} total)"
    for w in query.split():
        partial = "".join(known.get(x, "?") for x in w)
        if "?" not in partial:
            out.append(partial)
            lines.append(f'- "{w}" -> "{partial}" (fully mapped)')
            continue
        matches = [v for v in sorted(words) if form(v) == form(w) and len(v) == len(w) and all(p in ("?", x) for p, x in zip(partial, v))]
        fits = [v for v in matches if not any(p == "?" and x in known.values() for p, x in zip(partial, v))]
        pick = fits[0] if fits else partial
        added = {a: b for a, b in zip(w, pick) if a not in known and b != "?"}
        known |= added
        out.append(pick)
        told = ", ".join(f"{a}→{b}" for a, b in added.items()) or "none"
        lines.append(f'- "{w}" -> "{partial}"; vocab matches: {shown(matches)}; bijective matches: {shown(fits)}; choose "{pick}"; add {told}')
    lines += [f"S5: Decoded phrase = {' '.join(out)}", f"Answer: \\boxed{{{' '.join(out)}}}"]
    return "\n".join(lines)


def test_cipher_traces(spark):
    shift = str.maketrans("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm")
    enc = lambda t: t.translate(shift)
    rows, want = [], {}
    for i, (told, asked) in enumerate([(["the cat reads"], "the dragon chases the cat"), (["queen"], "wizard in cave"), (["key"], "zzz key"), (["book"], "a")]):
        pairs = [(enc(t), t) for t in told]
        prompt = "Examples:\n" + "\n".join(f"{a} -> {b}" for a, b in pairs) + f"\nNow, decrypt the following text: {enc(asked)}"
        rows.append((i, prompt))
        want[i] = plain_cipher(pairs, enc(asked), cipher.VOCABULARY)
    got = {r.id: r for r in traces.explain_ciphers(spark.createDataFrame(rows + [(99, "nothing"), (98, None)], "id int, prompt string")).collect()}
    assert {i: got[i].trace for i in want} == want
    assert got[0].decoded == "the dragon chases the cat" and got[99].trace is None and got[98].trace is None
    assert any("(fully mapped)" in t for t in want.values()) and any("total)" in t for t in want.values())


def test_steps_of_every_mode(spark):
    """The sentences of each way of writing, with and without a width, for both signs."""
    rows = [("12", "+", "30", lt, rt, rule, m, w) for m in numeric.MODES for w in (None, 4) for rule in ("x - y", "x + y") for lt, rt in (("id", "id"), ("rev", "id"))]
    df = spark.createDataFrame(rows, "left string, op string, right string, lt string, rt string, rule string, mode string, width int")
    e = F.struct("left", "op", "right", F.lit("12 + 30").alias("lhs"))
    got = df.select("*", traces.computation(e, F.struct("lt", "rt", "rule", "mode", "width")).alias("steps")).collect()
    for r in got:
        x = 21 if r.lt == "rev" else 12
        v = x - 30 if r.rule == "x - y" else x + 30
        wide, sign = str(abs(v)).zfill(r.width or 0), "-" if v < 0 else ""
        plain, back = sign + wide, sign + wide[::-1]
        never = f"if the result is nonnegative, write it directly: {v} -> {v}"
        final, said = {
            "plain": (plain, f"pad the result to 4 digits: {v} -> {plain}" if r.width else f"write the result directly: {v}"), "rev": (back, f"reverse the result text: {plain} -> {back}"),
            "neg": ("-" + wide, f"write the negative form of the magnitude: {v} -> -{wide}"), "neg_rev": ("-" + wide[::-1], f"reverse the digits, then write the negative form: {v} -> -{wide[::-1]}"),
            "op_prefix": ("+" + plain, f"put the operator in front: {plain} -> +{plain}"), "op_suffix": (plain + "+", f"put the operator at the end: {plain} -> {plain}+"),
            "op_prefix_rev": ("+" + back, f"reverse the digits, then put the operator in front: {back} -> +{back}"), "op_suffix_rev": (back + "+", f"reverse the digits, then put the operator at the end: {back} -> {back}+"),
            "op_prefix_if_neg": ("+" + wide, f"if the result is negative, write the operator then the magnitude: {v} -> +{wide}") if v < 0 else (str(v), never),
            "op_suffix_rev_if_neg": (wide[::-1] + "+", f"if the result is negative, reverse the magnitude and put the operator at the end: {v} -> {wide[::-1]}+") if v < 0 else (str(v), never),
        }[r.mode]
        turned = ["reverse the left operand: 12 -> 21"] if r.lt == "rev" else []
        assert r.steps == [*turned, f"apply {r.rule}: {r.rule.replace('x', str(x)).replace('y', '30')} = {v}", said, f"so 12 + 30 becomes {final}"]


def test_the_worked_example_and_puzzles_without_an_own_example(spark):
    prompts = [(1, "Rules\n82/15 = 8241\n31/22 = 3154\nNow, determine the result for: 85/77"), (2, "Rules\n1 + 2 = 3\n4 + 4 = 8\nNow, determine the result for: 5 * 6"), (3, "nothing")]
    got = {r.id: r for r in traces.explain_digits(numeric.puzzles(spark.createDataFrame(prompts, "id int, prompt string"))).collect()}
    assert set(got) == {1, 2} and got[2].trace is None
    if got[1].trace is not None:
        assert got[1].trace.startswith("Each operator can follow its own hidden rule") and got[1].trace.endswith(f"So the result is {got[1].prediction}.")
