"""SQL text for Spark's ``hash`` (32-bit Murmur3), to check seeded noise in another engine.

Values are unsigned 32-bit numbers kept in UBIGINT. Strings are ASCII and come as a list of
pre-mixed words: four bytes at a time, then the remaining bytes one by one.
"""

from __future__ import annotations

# The published Murmur3 constants and Spark's seed.
MASK = 4294967295
C1 = 3432918353
C2 = 461845907
ADD = 3864292196
F1 = 2246822507
F2 = 3266489909
SPARK_SEED = 42


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _rotate(name: str, bits: int) -> str:
    return f"((({name} << {bits}) & {MASK}) | ({name} >> {32 - bits}))"


def _mixed_word(word: str) -> str:
    scaled = f"((({word})::UBIGINT * {C1}) & {MASK})"
    return _let("mw", scaled, f"(({_rotate('mw', 15)} * {C2}) & {MASK})")


def _step(state: str, mixed: str) -> str:
    return _let("st", f"xor({state}, {mixed})", f"(({_rotate('st', 13)} * 5 + {ADD}) & {MASK})")


def _finish(state: str, length: str) -> str:
    x = _let("f1", f"xor({state}, ({length})::UBIGINT)", "xor(f1, f1 >> 16)")
    x = _let("f2", f"(({x} * {F1}) & {MASK})", "xor(f2, f2 >> 13)")
    return _let("f3", f"(({x} * {F2}) & {MASK})", "xor(f3, f3 >> 16)")


def words(text: str) -> str:
    """List of mixed words of a string expression."""
    byte = "ord(substr({t}, ({i})::BIGINT, 1))::UBIGINT"

    def at(index: str) -> str:
        return byte.format(t=text, i=index)

    four = " + ".join(f"{at(f'4 * b + {k + 1}')} * {256 ** k}" for k in range(4))
    whole = f"list_transform(range(0, length({text}) // 4), lambda b: {_mixed_word(four)})"
    tail = (
        f"list_transform(range(length({text}) - length({text}) % 4, length({text})), "
        f"lambda b: {_mixed_word(at('b + 1'))})"
    )
    return f"list_concat({whole}, {tail})"


def add_words(state: str, word_list: str, length: str) -> str:
    """State after one more string argument."""
    reduced = f"list_reduce({word_list}, lambda h, w: {_step('h', 'w')}, {state})"
    return _finish(reduced, length)


def add_text(state: str, text: str) -> str:
    return add_words(state, words(text), f"length({text})")


def add_date(state: str, date: str) -> str:
    """State after one more date argument (hashed as days since 1970)."""
    day = f"date_diff('day', DATE '1970-01-01', {date})"
    return _finish(_step(state, _mixed_word(day)), "4")


def start(seed: int, salt: str) -> str:
    state = add_text(f"{SPARK_SEED}::UBIGINT", f"'{seed}'")
    return add_text(state, f"'{salt}'")


def bucket(state: str, modulo: int) -> str:
    """Non-negative remainder of the signed hash."""
    signed = f"({state})::BIGINT"
    signed = _let("sg", signed, "CASE WHEN sg >= 2147483648 THEN sg - 4294967296 ELSE sg END")
    return _let("md", signed, f"((md % {modulo}) + {modulo}) % {modulo}")
