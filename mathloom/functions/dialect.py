"""SQL text for Spark and, for checks on the same tables, for DuckDB.

The operators of this package are SQL expressions and queries written once as
templates. A dialect fills in the few spellings that differ: string literals,
regular expressions, array functions. Patterns keep to what Java and RE2 read alike:
no look-around, no \\b, \\z instead of $.
"""

from __future__ import annotations

import re

from .required import UPPER, beyond_ascii, required

#: A column or a variable by name: what may be read several times at no cost.
NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?|`[^`]+`")
#: Characters that the squeezed text does without, as a pattern: those of required.SQUEEZED_OUT.
SQUEEZED_OUT = r"[\s{}\\]+"
#: Rules written so that a match that would give way to itself is none: a single blank among runs of them.
SAME = {(r"\s+", " "): r"\s{2,}|[\t\n\x0B\f\r]", (" +", " "): " {2,}"}


def _shortest(strings) -> list[str]:
    """Of some strings those that hold no other: a text that holds any holds one of these."""
    each = list(dict.fromkeys(strings))
    return [s for s in each if not any(o != s and o in s for o in each)]


class Spark:
    name = "spark"

    @staticmethod
    def lit(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def match(self, x: str, pattern: str) -> str:
        plain = f"({x} RLIKE {self.lit(pattern)})"
        guard = self._may_match(x, None, pattern) if NAME.fullmatch(x) else ""
        return f"({guard} AND {plain})" if guard else plain

    def sub(self, x: str, pattern: str, by: str) -> str:
        """All matches replaced; \\1 stands for a group and \\\\ for a backslash in `by`."""
        java = re.sub(r"\\([0-9])", r"$\1", by.replace("$", "\\$"))
        pattern = SAME.get((pattern, by), pattern)
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(java)})"

    def once(self, x: str, body) -> str:
        """body of a name for x, which is computed once for it."""
        return self.at(f"transform(array({x}), once -> {body('once')})", "1")

    def squeezed(self, x: str) -> str:
        """The text in which required() looks for letters that may stand apart. At ASCII alone, small letters don't hang on the machine's language."""
        small = f"CASE WHEN octet_length({x}) = length({x}) THEN lower({x}) ELSE translate({x}, '{UPPER}', '{UPPER.lower()}') END"
        return f"regexp_replace({small}, {self.lit(SQUEEZED_OUT)}, '')"

    def _may_match(self, x: str, squeezed: str | None, pattern: str) -> str:
        """Whether x holds what a pattern asks for; nothing where nothing is known."""
        plain, apart = required(pattern)
        tests = [has(self, y, *strings) for y, strings in ((squeezed, apart), (x, plain)) if y and strings]
        signs = beyond_ascii(pattern)
        if signs is not None:
            tests.append("(" + " OR ".join([f"octet_length({x}) > length({x})", *([has(self, x, *signs)] if signs else [])]) + ")")
        return " AND ".join(tests)

    def _tried(self, x: str, patterns, body, squeezed: str | None = None) -> str:
        """body(tests) with a test for each pattern, of which the costly ones are run only where they may match. squeezed: a column with the squeezed text."""
        if not any(required(p)[1] for p in patterns) or not NAME.fullmatch(x):
            return body([self.match(x, p) for p in patterns])
        tests = []
        for p in patterns:
            guard = self._may_match(x, squeezed or "squeezed", p)
            tests.append(f"({guard} AND {x} RLIKE {self.lit(p)})" if guard else f"({x} RLIKE {self.lit(p)})")
        if squeezed:
            return body(tests)
        return self.at(f"transform(array({self.squeezed(x)}), squeezed -> {body(tests)})", "1")

    def fired(self, x: str, rules, squeezed: str | None = None) -> str:
        return self._tried(x, [p for p, _ in rules], lambda tests: self.compact(self.array(*[f"CASE WHEN {t} THEN {self.lit(label)} END" for t, (_, label) in zip(tests, rules)])), squeezed)

    def any_match(self, x: str, patterns, squeezed: str | None = None) -> str:
        return "(" + self._tried(x, list(patterns), lambda tests: " OR ".join(tests), squeezed) + ")"

    def chain(self, x: str, rules, turns: int = 1) -> str:
        """Rules folded over a text one by one, all of them `turns` times; a rule is run only on a text that holds what its pattern asks for.

        The text is carried with its squeezed form, if a rule asks for that, which is made anew when the text changes.
        A turn begins only on a text that holds what one of the rules asks for: on others none would change it.
        """
        rules = list(rules)
        if turns == 1:
            return self._once_through(x, rules)
        asked = [required(p) for p, _ in rules]
        if not any(map(any, asked)):
            for pattern, by in rules * turns:
                x = self.sub(x, pattern, by)
            return x
        both = any(apart for _, apart in asked)
        squeezed, made = ".s" if both else None, f"named_struct('t', fresh, 's', {self.squeezed('fresh')})" if both else "fresh"
        text = ".t" if both else ""

        def step(pattern: str, by: str) -> str:
            plain, apart = required(pattern)
            # a single string has been looked for by the fold
            several = [has(self, f"so_far{part}", *strings) for part, strings in ((squeezed, apart), (text, plain)) if part is not None and len(strings) > 1]
            done = self.sub(f"so_far{text}", pattern, by)
            if both:
                done = self.at(f"transform(array({done}), fresh -> CASE WHEN fresh = so_far.t THEN so_far ELSE {made} END)", "1")
            return f"CASE WHEN {' AND '.join(several)} THEN {done} ELSE so_far END" if several else done

        def steps(lo: int, hi: int) -> str:
            """The rule by number, found by halving."""
            if hi - lo == 1:
                return step(*rules[lo])
            middle = (lo + hi) // 2
            return f"CASE WHEN rule.k < {middle} THEN {steps(lo, middle)} ELSE {steps(middle, hi)} END"

        def single(strings) -> str:
            return self.lit(strings[0] if len(strings) == 1 else "")

        table = ", ".join(f"named_struct('k', {k}, 't', {single(plain)}, 's', {single(apart)})" for k, (plain, apart) in enumerate(asked))
        meets = f"contains(so_far{text}, rule.t)" + (" AND contains(so_far.s, rule.s)" if both else "")
        folded = f"aggregate(array({table}), begun, (so_far, rule) -> CASE WHEN {meets} THEN {steps(0, len(rules))} ELSE so_far END)"
        if all(map(any, asked)):
            in_squeezed, in_text = (_shortest(s for plain, apart in asked for s in chosen(plain, apart)) for chosen in (lambda plain, apart: apart, lambda plain, apart: () if apart else plain))
            tests = [has(self, f"begun{part}", *strings) for part, strings in ((squeezed, in_squeezed), (text, in_text)) if strings]
            guarded = f"CASE WHEN {' OR '.join(tests)} THEN %s ELSE begun END"
            folded = guarded.replace("%s", folded)
        else:
            guarded = "%s"
        if turns > 1:
            folded = guarded.replace("%s", f"aggregate(sequence(1, {turns}), begun, (begun, turn) -> {folded})")
        done = f"{self.at(f'transform(array({made}), begun -> {folded})', '1')}{text}"
        # what all rules ask for is looked for once
        shared = [c for c in "_\\" if all(plain and all(c in s for s in plain) for plain, _ in asked)]
        if shared:
            done = f"CASE WHEN {' AND '.join(has(self, 'fresh', c) for c in shared)} THEN {done} ELSE fresh END"
        return self.at(f"transform(array({x}), fresh -> {done})", "1")

    def _once_through(self, x: str, rules) -> str:
        """Rules folded over a text one by one, with less nesting than chain() in several turns: Spark plans deep expressions by recursion.

        The text is carried with its squeezed form, if a rule asks for that, which is made anew when the text changes.
        """
        rules = list(rules)
        asked = [required(p) for p, _ in rules]
        if not any(map(any, asked)):
            for pattern, by in rules:
                x = self.sub(x, pattern, by)
            return x
        both = any(apart for _, apart in asked)
        text, made = ("so_far.t", f"named_struct('t', fresh, 's', {self.squeezed('fresh')})") if both else ("so_far", "fresh")

        def step(pattern: str, by: str) -> str:
            guard = self._may_match(text, "so_far.s" if both else None, pattern)
            done = self.sub(text, pattern, by)
            if both:
                done = self.at(f"transform(array({done}), fresh -> CASE WHEN fresh = so_far.t THEN so_far ELSE {made} END)", "1")
            return f"CASE WHEN {guard} THEN {done} ELSE so_far END" if guard else done

        def steps(lo: int, hi: int) -> str:
            """The rule by number, found by halving."""
            if hi - lo == 1:
                return step(*rules[lo])
            middle = (lo + hi) // 2
            return f"CASE WHEN rule < {middle} THEN {steps(lo, middle)} ELSE {steps(middle, hi)} END"

        end = ", so_far -> so_far.t" if both else ""
        folded = f"aggregate(sequence(0, {len(rules) - 1}), {made}, (so_far, rule) -> {steps(0, len(rules))}{end})"
        # what all rules ask for is looked for once
        shared = [c for c in "_\\" if all(plain and all(c in s for s in plain) for plain, _ in asked)]
        if shared:
            folded = f"CASE WHEN {' AND '.join(has(self, 'fresh', c) for c in shared)} THEN {folded} ELSE fresh END"
        return self.at(f"transform(array({x}), fresh -> {folded})", "1")

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def compact(self, x: str) -> str:
        return f"filter({x}, y -> y IS NOT NULL)"

    def keep(self, x: str, test: str) -> str:
        return f"filter({x}, y -> {test})"

    def each(self, x: str, to: str) -> str:
        return f"transform({x}, y -> {to})"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, {self.lit(by)})"

    def interleave(self, parts: str, between: str) -> str:
        """The text of the first of parts, the first of between, the second of parts and so on."""
        return f"array_join(zip_with({parts}, {between}, (y, z) -> concat(y, coalesce(z, ''))), '')"

    def lookup(self, pairs, key: str) -> str:
        """What a fixed table of (text, text) holds for a key; null if nothing."""
        return f"try_element_at(map({', '.join(self.lit(t) for pair in pairs for t in pair)}), {key})"

    def concat_arrays(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def at(self, x: str, i: str) -> str:
        """Element by place from 1; null beyond the end."""
        return f"try_element_at({x}, CAST({i} AS INT))"

    def slice(self, x: str, first: str, n: str) -> str:
        return f"slice({x}, {first}, {n})"

    def fold(self, x: str, first: str, step: str) -> str:
        """The numbers of x folded from the left: step is an expression in a, what there is, and y."""
        return f"aggregate({x}, {first}, (a, y) -> {step})"

    def any(self, x: str, test: str) -> str:
        return f"exists({x}, y -> {test})"

    def reverse(self, x: str) -> str:
        return f"reverse({x})"

    def explode(self, x: str, alias: str, pos: str | None = None) -> str:
        """A FROM item: rows of an array of the tables before it, with places from 0.

        The array is wrapped, as Spark adds a filter on the size of an array that is a
        column, and pushes it, with all that the column is computed from, below the
        aggregation that was to keep it from being computed for every row.
        """
        whole = f"filter({x}, y -> true)"
        if pos:
            return f"LATERAL VIEW posexplode({whole}) t_{alias} AS {pos}, {alias}"
        return f"LATERAL VIEW explode({whole}) t_{alias} AS {alias}"

    def numbers(self, first: str, last: str) -> str:
        return f"sequence({first}, {last})"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} DIV {b})"

    def cp(self, x: str) -> str:
        """Code point of the first character."""
        return f"ascii({x})"

    def char(self, x: str) -> str:
        return f"decode(unhex(lpad(hex({x}), 8, '0')), 'UTF-32')"

    def hex(self, x: str) -> str:
        """A number in upper-case hexadecimal digits."""
        return f"hex({x})"

    def from_hex(self, x: str) -> str:
        """The number that hexadecimal digits stand for, null if there are none."""
        return f"CAST(conv(nullif({x}, ''), 16, 10) AS INT)"

    def max_by(self, x: str, *by: str) -> str:
        return f"max_by({x}, struct({', '.join(by)}))"

    def ordered(self, x: str, *by: str) -> str:
        """Array of x of a group, in the order of `by`."""
        keys = ", ".join(f"{b} AS k{i}" for i, b in enumerate(by))
        return f"transform(array_sort(collect_list(struct({keys}, {x} AS v))), z -> z.v)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"


class Duck(Spark):
    name = "duckdb"

    def once(self, x: str, body) -> str:
        return body(x)

    def fired(self, x: str, rules, squeezed: str | None = None) -> str:
        return self.compact(self.array(*[f"CASE WHEN {self.match(x, p)} THEN {self.lit(label)} END" for p, label in rules]))

    def any_match(self, x: str, patterns, squeezed: str | None = None) -> str:
        return "(" + " OR ".join(self.match(x, p) for p in patterns) + ")"

    def chain(self, x: str, rules, turns: int = 1) -> str:
        for pattern, by in list(rules) * turns:
            x = self.sub(x, pattern, by)
        return x

    @staticmethod
    def lit(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def split(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.lit(pattern)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def compact(self, x: str) -> str:
        return f"list_filter({x}, lambda y: y IS NOT NULL)"

    def keep(self, x: str, test: str) -> str:
        return f"list_filter({x}, lambda y: {test})"

    def each(self, x: str, to: str) -> str:
        return f"list_transform({x}, lambda y: {to})"

    def join(self, x: str, by: str) -> str:
        return f"array_to_string({x}, {self.lit(by)})"

    def interleave(self, parts: str, between: str) -> str:
        return f"array_to_string(list_transform(list_zip({parts}, {between}), lambda y: concat(y[1], coalesce(y[2], ''))), '')"

    def lookup(self, pairs, key: str) -> str:
        return f"list_extract(map_extract(MAP {{{', '.join(f'{self.lit(a)}: {self.lit(b)}' for a, b in pairs)}}}, {key}), 1)"

    def concat_arrays(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def size(self, x: str) -> str:
        return f"len({x})"

    def at(self, x: str, i: str) -> str:
        return f"list_extract({x}, {i})"

    def slice(self, x: str, first: str, n: str) -> str:
        return f"list_slice({x}, {first}, {first} + {n} - 1)"

    def fold(self, x: str, first: str, step: str) -> str:
        return f"list_reduce(list_prepend({first}, {x}), lambda a, y: {step})"

    def any(self, x: str, test: str) -> str:
        return f"(len(list_filter({x}, lambda y: {test})) > 0)"

    def reverse(self, x: str) -> str:
        return f"reverse({x})"

    def explode(self, x: str, alias: str, pos: str | None = None) -> str:
        if pos:
            return f", LATERAL (SELECT unnest(range(0, len({x}))) AS {pos}, unnest({x}) AS {alias}) t_{alias}"
        return f", LATERAL (SELECT unnest({x}) AS {alias}) t_{alias}"

    def numbers(self, first: str, last: str) -> str:
        return f"range({first}, {last} + 1)"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def cp(self, x: str) -> str:
        return f"unicode({x})"

    def char(self, x: str) -> str:
        return f"chr({x})"

    def hex(self, x: str) -> str:
        return f"printf('%X', CAST({x} AS BIGINT))"

    def from_hex(self, x: str) -> str:
        return f"CAST(('0x' || nullif({x}, '')) AS INT)"

    def max_by(self, x: str, *by: str) -> str:
        return f"arg_max({x}, ({', '.join(by)}))"

    def ordered(self, x: str, *by: str) -> str:
        return f"list({x} ORDER BY {', '.join(by)})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '$.{path}')"


SPARK, DUCK = Spark(), Duck()


def chain(d: Spark, x: str, rules, turns: int = 1) -> str:
    """Ordered rewriting rules (pattern, replacement), each over what those before it leave, all of them `turns` times."""
    return d.chain(x, rules, turns)


def fired(d: Spark, x: str, rules, squeezed: str | None = None) -> str:
    """Array of the labels of the rules (pattern, label) that match, in their order. squeezed: a column with the squeezed text, if there is one."""
    return d.fired(x, rules, squeezed)


def any_match(d: Spark, x: str, patterns, squeezed: str | None = None) -> str:
    return d.any_match(x, patterns, squeezed)


def has(d: Spark, x: str, *parts: str) -> str:
    """Whether x holds one of some plain strings."""
    return "(" + " OR ".join(f"contains({x}, {d.lit(p)})" for p in parts) + ")"


def count_of(d: Spark, x: str, part: str) -> str:
    """How often a plain string comes in x."""
    return d.idiv(f"(length({x}) - length(replace({x}, {d.lit(part)}, '')))", str(len(part)))
