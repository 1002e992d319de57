"""DuckDB equivalents of the k-mer queries."""

from __future__ import annotations

#: Derived reads, as helixspark.plans.catalog.reads makes them.
READS = "reads AS (SELECT doc_id AS rid, translate(upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')), 'N', 'A') AS seq FROM documents WHERE length(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) > 0)"


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def canonical(s: str) -> str:
    return f"least({s}, {rc(s)})"


def windows(k: int, name: str = "kmer") -> str:
    """CTE f: rid, pos and forward windows."""
    starts = f"(SELECT rid, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM reads WHERE length(seq) >= {k})"
    return f"f AS (SELECT rid, pos::INTEGER AS pos, substr(seq, pos + 1, {k}) AS {name} FROM {starts})"


def counts(k: int, lo: int = 1, hi: int = 65535) -> str:
    """CTEs up to c: kmer, cnt."""
    return f"WITH {READS}, {windows(k)}, c AS (SELECT {canonical('kmer')} AS kmer, count(*) AS cnt FROM f GROUP BY 1 HAVING count(*) BETWEEN {lo} AND {hi})"


def pack(s: str, n: int) -> str:
    """2-bit value of n bases as UBIGINT."""
    digits = f"translate({s}, 'ACGT', '0123')"
    return " + ".join(f"(ascii(substr({digits}, {i + 1}, 1)) - 48)::UHUGEINT * {4 ** (n - 1 - i)}::UHUGEINT" for i in range(n))


def _times(x: str, c: int) -> str:
    return f"(({x})::UHUGEINT * {c}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _plus(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def signed(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808::UBIGINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


def _rotl(x: str, r: int) -> str:
    return f"((({x})::UHUGEINT * {1 << r}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT + (({x}) >> {64 - r})"


def murmur(source: str, keep: str, kmer: str, m: int, seed: int = 313) -> str:
    """CTEs h0.. of the murmur hash of packed m-mers, 32 bases a word, ending in ``hashed``: keep columns, h and h2 (UBIGINT), the halves."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    sizes = [min(32, m - a) for a in range(0, m, 32)]
    words = ", ".join(f"(({pack(f'substr({kmer}, {32 * i + 1}, {n})', n)}) * {4 ** (32 - n)}::UHUGEINT)::UBIGINT AS w{i}" for i, n in enumerate(sizes))
    carried, steps = ", ".join(f"w{i}" for i in range(len(sizes))), []

    def step(select: str, carry: bool = True) -> None:
        steps.append(f"h{len(steps)} AS (SELECT {keep}, {f'{carried}, ' if carry else ''}{select} FROM {f'h{len(steps) - 1}' if steps else source})")

    step(f"{words}, {seed}::UBIGINT AS a, {seed}::UBIGINT AS b", carry=False)

    def mixed_in(word: int, first: bool, into: str) -> None:
        other = "b" if into == "a" else "a"
        step(f"a, b, {_times(f'w{word}', c1 if first else c2)} AS x")
        step(f"a, b, {_rotl('x', 31 if first else 33)} AS x")
        step(f"{other}, xor({into}, {_times('x', c2 if first else c1)}) AS {into}")

    for i in range(0, len(sizes) - 1, 2):
        for word, first, into, turn, more in ((i, True, "a", 27, 0x52DCE729), (i + 1, False, "b", 31, 0x38495AB5)):
            other = "b" if into == "a" else "a"
            mixed_in(word, first, into)
            step(f"{other}, {_rotl(into, turn)} AS {into}")
            step(f"{other}, {_plus(into, other)} AS {into}")
            step(f"{other}, {_plus(_times(into, 5), f'{more}::UBIGINT')} AS {into}")
    if len(sizes) % 2:
        mixed_in(len(sizes) - 1, True, "a")
    step(f"xor(a, {8 * len(sizes)}::UBIGINT) AS a, xor(b, {8 * len(sizes)}::UBIGINT) AS b", carry=False)
    for select in (f"{_plus('a', 'b')} AS a, b", f"a, {_plus('b', 'a')} AS b"):
        step(select, carry=False)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, None):
        step("xor(a, a >> 33) AS a, xor(b, b >> 33) AS b", carry=False)
        if factor:
            step(f"{_times('a', factor)} AS a, {_times('b', factor)} AS b", carry=False)
    step(f"{_plus('a', 'b')} AS a, b", carry=False)
    steps.append(f"hashed AS (SELECT {keep}, a AS h, {_plus('b', 'a')} AS h2 FROM h{len(steps) - 1})")
    return ", ".join(steps)


def superfast(source: str, keep: str, text: str, n: int) -> str:
    """CTEs of SuperFastHash of ASCII strings of n characters, ending in ``fast``: keep columns and h, as UBIGINT below 2 ** 32."""
    steps, wrap = [f"s0 AS (SELECT {keep}, {text} AS t, {n}::UBIGINT AS h FROM {source})"], lambda x: f"(({x}) & 4294967295::UBIGINT)"
    byte = lambda i: f"ascii(substr(t, {i + 1}, 1))::UBIGINT"
    short = lambda i: f"({byte(i)} + {byte(i + 1)} * 256)"
    left, right = lambda n: f"xor(h, {wrap(f'h * {1 << n}')})", lambda n: wrap(f"h + (h >> {n})")

    def step(expr: str) -> None:
        steps.append(f"s{len(steps)} AS (SELECT {keep}, t, {expr} AS h FROM s{len(steps) - 1})")

    for i in range(0, n // 4 * 4, 4):
        step(wrap(f"h + {short(i)}"))
        step(f"xor({wrap('h * 65536')}, xor({short(i + 2)} * 2048, h))")
        step(right(11))
    at, rest = n // 4 * 4, n % 4
    if rest:
        step(wrap(f"h + {byte(at) if rest == 1 else short(at)}"))
        step(left({3: 16, 2: 11, 1: 10}[rest]))
        if rest == 3:
            step(f"xor(h, {byte(at + 2)} * {1 << 18})")
        step(right({3: 11, 2: 17, 1: 1}[rest]))
    for shift, back in ((3, 5), (4, 17), (25, 6)):
        step(left(shift))
        step(right(back))
    steps.append(f"fast AS (SELECT {keep}, h FROM s{len(steps) - 1})")
    return ", ".join(steps)


def minimizers(k: int, m: int) -> str:
    """CTEs up to z: rid, pos, h (UBIGINT) of each k-mer."""
    hashes = murmur(f"(SELECT rid, pos, {canonical('mmer')} AS mmer FROM f)", "rid, pos", "mmer", m)
    wide = k - m
    frame = f"(PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {wide} FOLLOWING)"
    mins = f"mins AS (SELECT rid, pos, min(h) OVER {frame} AS h, count(*) OVER {frame} AS n FROM hashed)"
    return f"WITH {READS}, {windows(m, 'mmer')}, {hashes}, {mins}, z AS (SELECT rid, pos, h FROM mins WHERE n = {wide + 1})"


def supermers(k: int, m: int, tasks: int, max_len: int) -> str:
    """CTEs up to s: rid, pos, len, task, seq."""
    cap = max_len - k + 1
    return (
        minimizers(k, m) + f", t AS (SELECT rid, pos, (h % {tasks}::UBIGINT)::INTEGER AS task FROM z)"
        ", e AS (SELECT *, coalesce(task <> lag(task) OVER (PARTITION BY rid ORDER BY pos), true)::INT AS edge FROM t)"
        ", r AS (SELECT *, sum(edge) OVER (PARTITION BY rid ORDER BY pos) AS run FROM e)"
        f", c AS (SELECT *, (row_number() OVER (PARTITION BY rid, run ORDER BY pos) - 1) // {cap} AS chunk FROM r)"
        f", g AS (SELECT rid, run, chunk, min(pos) AS pos, (count(*) + {k - 1})::INTEGER AS len, any_value(task) AS task FROM c GROUP BY 1, 2, 3)"
        ", s AS (SELECT g.rid, g.pos, g.len, g.task, substr(reads.seq, g.pos + 1, g.len) AS seq FROM g JOIN reads USING (rid))"
    )
