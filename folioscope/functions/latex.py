"""Symbols of formulas in LaTeX: read by a scanner, compared with the symbols that an explanation names, corrected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.terms import formula_form

# Commands that are symbols themselves, and those that carry symbols in their argument.
SYMBOLS = {
    "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "vartheta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi",
    "rho", "varrho", "sigma", "varsigma", "tau", "upsilon", "phi", "varphi", "chi", "psi", "omega", "digamma", "beth", "aleph", "ell", "hbar", "imath", "jmath",
}
CARRIERS = {"mathrm", "text", "mathit", "mathbf", "pmb", "boldsymbol", "bm", "mbox", "operatorname"}

#: One piece of a formula: a command, a letter that may be a symbol, anything else.
PIECE = re.compile(r"\\(?P<command>[A-Za-z]*)\s*|(?P<letter>[A-Za-zΑ-Ωα-ω])|.", re.S)
WORD = re.compile("[A-Za-z0-9]+")
COMMAND = re.compile(r"\\([A-Za-z]+)")


def _group(text: str, at: int) -> int:
    """Where the group that opens at a brace ends; the end of the text if it is never closed."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    return len(text)


def _subscript(text: str, at: int) -> tuple[str, int]:
    """The subscript that follows, a group or a run of letters and digits, and where the text goes on."""

    def blanks(i: int) -> int:
        return len(text) - len(text[i:].lstrip())

    mark = blanks(at)
    if not text.startswith("_", mark):
        return "", mark
    start = blanks(mark + 1)
    if text.startswith("{", start):
        end = _group(text, start)
    else:
        word = WORD.match(text, start)
        end = word.end() if word else start
    return text[start:end], end


def _is_symbol(command: str) -> bool:
    return command.lower() in SYMBOLS


def plain(symbol: str) -> str:
    """A symbol without formatting commands, braces, blanks and underscores; commands that are symbols stay."""
    shown = COMMAND.sub(lambda m: m[0] if _is_symbol(m[1]) else "", symbol)
    return re.sub(r"[\s{}_]", "", shown)


def tokens(formula: str) -> Iterator[tuple[str, str, str]]:
    """(as written, base, plain form) of each symbol: letters and commands that are symbols, with their subscripts. Arguments of
    other commands are passed over, but for those that carry symbols."""
    at = 0
    while found := PIECE.match(formula, at):
        at = found.end()
        command = found["command"]
        if found["letter"] or (command and _is_symbol(command)):
            base = found["letter"] or f"\\{command}"
            low, at = _subscript(formula, found.end())
            yield formula[found.start() : at].strip() if found["letter"] else formula[found.start() : at], base, base + plain(low)
        elif command is not None and command not in CARRIERS and formula.startswith("{", at):
            at = _group(formula, at)


def base_of(symbol: str) -> str:
    """The letter or the command that a symbol begins with; empty if there is none."""
    command = COMMAND.match(symbol)
    if command and _is_symbol(command[1]):
        return command[0]
    letter = re.search("[A-Za-zΑ-Ωα-ω]", symbol)
    return letter[0] if letter and symbol.startswith(letter[0]) else ""


def rebuilt(base: str, symbol: str) -> str:
    """The base with the subscript that another symbol has, as that writes it."""
    if "_" not in symbol:
        return base
    low, _ = _subscript(symbol, symbol.index("_"))
    return f"{base}_{low}" if low else base


def corrections(formula: str, parameters: list[str]) -> list[tuple[str, str, str]]:
    """(base, as written, corrected): symbols that differ in their subscript from the one parameter of the same base. Where several
    parameters share a base, none is corrected, as nobody can tell which is meant."""
    found = list(tokens(formula))
    first: dict[str, str] = {}
    forms: dict[str, set[str]] = {}
    for raw, base, form in found:
        first.setdefault(base, raw)
        forms.setdefault(base, set()).add(form)
    named: dict[str, list[str]] = {}
    for symbol in filter(None, parameters):
        if (base := base_of(symbol)) in forms:
            named.setdefault(base, []).append(symbol)
    out = []
    for base, symbols in named.items():
        if len(symbols) == 1 and plain(symbols[0]) not in forms[base]:
            new = rebuilt(base, symbols[0])
            if new != first[base]:
                out.append((base, first[base], new))
    return out


# ---------------------------------------------------------------- as columns


def symbol_tokens(formula: Column) -> Column:
    """Array of (raw, base, form) of a formula's symbols, in their order; a null formula has none."""

    def scan(formulas: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("raw", pa.string()), ("base", pa.string()), ("form", pa.string())]))
        return pa.array([[dict(zip(("raw", "base", "form"), t, strict=True)) for t in tokens(f or "")] for f in formulas.to_pylist()], kind)

    return F.arrow_udf(scan, "array<struct<raw: string, base: string, form: string>>")(formula)


def symbol_corrections(formula: Column, parameters: Column) -> Column:
    """Array of (symbol, original, corrected) of a formula by the symbols (array of strings) that its explanation names."""

    def correct(formulas: pa.Array, named: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("symbol", pa.string()), ("original", pa.string()), ("corrected", pa.string())]))
        pairs = zip(formulas.to_pylist(), named.to_pylist(), strict=True)
        return pa.array([[dict(zip(("symbol", "original", "corrected"), c, strict=True)) for c in corrections(f or "", p or [])] for f, p in pairs], kind)

    return F.arrow_udf(correct, "array<struct<symbol: string, original: string, corrected: string>>")(formula, F.transform(parameters, formula_form))


def corrected(formula: Column, found: Column) -> Column:
    """A formula with the first place of each corrected symbol replaced."""

    def once(text: Column, c: Column) -> Column:
        place = F.instr(text, c["original"])
        put = F.concat(F.substring(text, F.lit(1), place - 1), c["corrected"], F.substring(text, place + F.char_length(c["original"]), F.char_length(text)))
        return F.when(place > 0, put).otherwise(text)

    return F.aggregate(found, formula, once)
