"""SQL text that states the expected result of a query, for a single-node SQL engine.

Learners are unrolled into one block of common table expressions per batch and pass.
"""

from __future__ import annotations

from textrill.config import FtrlConfig

CFG = FtrlConfig()


def r6(value: str, digits: int = 6) -> str:
    return f"(round({value}, {digits}) + 0.0)"


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED (\n{body}\n)" for name, body in ctes)


def weight(z: str, n: str, cfg: FtrlConfig = CFG) -> str:
    return (
        f"CASE WHEN abs({z}) <= {cfg.lambda1}::DOUBLE THEN 0.0::DOUBLE ELSE "
        f"-({z} - sign({z}) * {cfg.lambda1}::DOUBLE) / ({cfg.lambda2}::DOUBLE + "
        f"({cfg.beta}::DOUBLE + sqrt({n})) / {cfg.alpha}::DOUBLE) END"
    )


def batch_of(order: str, table: str, batches: int) -> str:
    low, high = f"(SELECT min({order}) FROM {table})", f"(SELECT max({order}) FROM {table})"
    return f"((({order} - {low}) * {batches}) // ({high} - {low} + 1))::INTEGER"


def ftrl_pass(name: str, feats: str, rows: str, labels: str, state: str, cfg: FtrlConfig = CFG):
    """Blocks of one pass: feats(id, idx, v), rows(id, y), labels(label, ord), state(label, idx, z, n)."""
    yield f"{name}_w", f"SELECT label, idx, z, n, {weight('z', 'n', cfg)} AS w FROM {state}"
    yield (
        f"{name}_m",
        f"SELECT r.id, l.label, coalesce(s.m, 0.0) AS m, (r.y = l.label)::INT::DOUBLE AS t "
        f"FROM {rows} r CROSS JOIN {labels} l LEFT JOIN ("
        f"SELECT f.id, w.label, sum(f.v * w.w) AS m FROM {feats} f JOIN {name}_w w ON w.idx = f.idx "
        f"GROUP BY f.id, w.label) s ON s.id = r.id AND s.label = l.label",
    )
    yield (
        f"{name}_g",
        f"SELECT m.id, m.label, f.idx, f.v * (1.0::DOUBLE / (1.0::DOUBLE + exp(-m.m)) - m.t) AS g "
        f"FROM {feats} f JOIN {name}_m m ON m.id = f.id",
    )
    yield (
        f"{name}_d",
        f"SELECT g.label, g.idx, sum(g.g - (sqrt(coalesce(w.n, 0) + g.g * g.g) - "
        f"sqrt(coalesce(w.n, 0))) / {cfg.alpha}::DOUBLE * coalesce(w.w, 0)) AS dz, sum(g.g * g.g) AS dn "
        f"FROM {name}_g g LEFT JOIN {name}_w w ON w.label = g.label AND w.idx = g.idx "
        f"GROUP BY g.label, g.idx",
    )
    yield (
        name,
        f"SELECT coalesce(s.label, d.label) AS label, coalesce(s.idx, d.idx) AS idx, "
        f"coalesce(s.z, 0) + coalesce(d.dz, 0) AS z, coalesce(s.n, 0) + coalesce(d.dn, 0) AS n "
        f"FROM {state} s FULL JOIN {name}_d d ON d.label = s.label AND d.idx = s.idx",
    )


def empty_state(index_type: str = "VARCHAR") -> tuple[str, str]:
    return (
        "s0",
        f"SELECT ''::VARCHAR AS label, NULL::{index_type} AS idx, 0.0::DOUBLE AS z, 0.0::DOUBLE AS n "
        "WHERE false",
    )


def prequential(
    rows: str, feats: str, batches: int, index_type: str, cfg: FtrlConfig = CFG, before=()
) -> tuple[str, list[str]]:
    """Blocks ending in ``scored(batch, id, y, pred, prob)`` and ``state``.

    ``rows(batch, id, y)`` and ``feats(batch, id, idx, v)`` name earlier blocks. A second
    round of passes after a drift is unrolled too and used only if the flag is set.
    """
    ctes = list(before)
    ctes.append(empty_state(index_type))
    ctes.append(("l_none", "SELECT ''::VARCHAR AS label, 0 AS ord WHERE false"))
    state, labels, scored = "s0", "l_none", []
    last = "NULL::DOUBLE"
    for b in range(batches):
        ctes.append((f"r{b}", f"SELECT id, y FROM {rows} WHERE batch = {b}"))
        ctes.append((f"f{b}", f"SELECT id, idx, v FROM {feats} WHERE batch = {b}"))
        if b:
            ctes += [
                (f"w{b}", f"SELECT label, idx, {weight('z', 'n', cfg)} AS w FROM {state}"),
                (
                    f"m{b}",
                    f"SELECT r.id, r.y, l.label, l.ord, coalesce(s.m, 0.0) AS m FROM r{b} r "
                    f"CROSS JOIN {labels} l LEFT JOIN (SELECT f.id, w.label, sum(f.v * w.w) AS m "
                    f"FROM f{b} f JOIN w{b} w ON w.idx = f.idx GROUP BY f.id, w.label) s "
                    f"ON s.id = r.id AND s.label = l.label",
                ),
                (
                    f"p{b}",
                    f"SELECT {b} AS batch, id, y, label AS pred, 1.0::DOUBLE / (1.0::DOUBLE + exp(-m)) AS prob "
                    f"FROM m{b} QUALIFY row_number() OVER (PARTITION BY id ORDER BY m DESC, ord) = 1",
                ),
                (
                    f"a{b}",
                    f"SELECT {b} AS batch, count(*)::BIGINT AS rows, sum((y = pred)::INT)::BIGINT AS correct, "
                    f"sum((y = pred)::INT)::DOUBLE / count(*) AS accuracy, "
                    f"coalesce({last} - sum((y = pred)::INT)::DOUBLE / count(*) > {cfg.drift_drop}::DOUBLE, false) AS drift "
                    f"FROM p{b}",
                ),
            ]
            scored.append(b)
            last = f"(SELECT accuracy FROM a{b})"
        ctes.append(
            (
                f"l{b}",
                f"SELECT label, ord FROM {labels} UNION ALL SELECT y, (SELECT count(*) FROM {labels}) + "
                f"row_number() OVER (ORDER BY y) - 1 FROM (SELECT DISTINCT y FROM r{b}) n "
                f"WHERE y NOT IN (SELECT label FROM {labels})",
            )
        )
        labels = f"l{b}"
        for k in range(cfg.passes):
            ctes += ftrl_pass(f"s{b}_{k}", f"f{b}", f"r{b}", labels, state, cfg)
            state = f"s{b}_{k}"
        if b > 1:
            again = state
            # the second round works on no rows unless the batch drifted
            ctes.append((f"fd{b}", f"SELECT f.* FROM f{b} f WHERE (SELECT drift FROM a{b})"))
            ctes.append((f"rd{b}", f"SELECT r.* FROM r{b} r WHERE (SELECT drift FROM a{b})"))
            for k in range(cfg.passes):
                ctes += ftrl_pass(f"d{b}_{k}", f"fd{b}", f"rd{b}", labels, again, cfg)
                again = f"d{b}_{k}"
            state = again
    union = " UNION ALL ".join(f"SELECT * FROM p{b}" for b in scored)
    acc = " UNION ALL ".join(f"SELECT * FROM a{b}" for b in scored)
    ctes += [("scored", union), ("accuracies", acc), ("state", f"SELECT * FROM {state}")]
    return with_(*ctes), scored


METRICS = (
    "\nSELECT batch::INTEGER AS batch, rows, correct, "
    + r6("accuracy")
    + " AS accuracy, drift FROM accuracies"
)
TOPICS = (
    "\nSELECT batch::INTEGER AS batch, pred AS topic, count(*)::BIGINT AS rows, "
    + r6("max(prob)")
    + " AS max_prob, "
    + r6("max(prob) * (count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY batch))")
    + " AS strength FROM scored GROUP BY batch, pred"
)
PREDICTIONS = "\nSELECT batch::INTEGER AS batch, id, y, pred, " + r6("prob") + " AS prob FROM scored"


# --- text -------------------------------------------------------------------------------


def java_split(t: str) -> str:
    return (
        f"(CASE WHEN {t} = '' THEN [''] WHEN rtrim({t}, ' ') = '' THEN []::VARCHAR[] "
        f"ELSE string_split(rtrim({t}, ' '), ' ') END)"
    )


def clear(t: str) -> str:
    return f"array_to_string({java_split(t)}, ' ')"


def spaced(t: str) -> str:
    """Text with line ends as separators too."""
    return f"replace({t}, chr(10), ' ')"


def plain(t: str) -> str:
    return f"regexp_replace({clear(t)}, '[^a-z|A-Z|0-9 ]', '', 'g')"


CLEANED = plain(spaced("text"))


def documents(batches: int = 1, y: str = "lang") -> tuple[str, str]:
    """``docs(batch, id, y, tokens)``: cleaned documents."""
    return (
        "docs",
        f"SELECT batch, id, y, {java_split('c')} AS tokens FROM (SELECT "
        f"{batch_of('doc_id', 'documents', batches)} AS batch, doc_id AS id, {y} AS y, "
        f"{CLEANED} AS c FROM documents)",
    )


LINES = (
    "lines",
    "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents",
)

TFIDF = [
    ("rows", "SELECT batch, id, y FROM docs"),
    (
        "tf",
        "SELECT batch, id, idx, count(*)::DOUBLE AS tf FROM "
        "(SELECT batch, id, unnest(tokens) AS idx FROM docs) GROUP BY ALL",
    ),
    ("df", "SELECT batch, idx, count(*) AS df FROM tf GROUP BY ALL"),
    ("m", "SELECT batch, count(*) AS m FROM docs GROUP BY ALL"),
    (
        "feats",
        "SELECT tf.batch, id, tf.idx, tf * ln((m + 1)::DOUBLE / (df + 1)::DOUBLE) AS v "
        "FROM tf JOIN df USING (batch, idx) JOIN m USING (batch)",
    ),
]

BASE_WORDS = (
    "base",
    f"SELECT DISTINCT unnest({java_split('c')}) AS word FROM (SELECT {CLEANED} AS c FROM benchmark)",
)


def hashed_vectors(source: str, size: int) -> str:
    """``(word, pos, x)``: the check vectors, from digits of a digest of the word."""
    return (
        "SELECT word, pos, ((('0x' || substr(md5(word || '#' || (pos // 16)), 2 * (pos % 16) + 1, 2))::INT "
        f"- 127.5::DOUBLE) / 1275.0::DOUBLE)::FLOAT::DOUBLE AS x FROM {source}, "
        f"(SELECT unnest(range({size})) AS pos)"
    )


def document_vectors(size: int, batches: int = 1, docs: str = "docs") -> list[tuple[str, str]]:
    """Blocks ending in ``vecs(batch, id, y, pos, x)``."""
    return [
        BASE_WORDS,
        ("wv", hashed_vectors("base", size)),
        (
            "tw",
            f"SELECT id, word, count(*) AS c FROM (SELECT id, unnest(tokens) AS word FROM {docs}) "
            "WHERE word IN (SELECT word FROM base) GROUP BY ALL",
        ),
        ("ts", "SELECT id, pos, sum(c * x) AS s FROM tw JOIN wv USING (word) GROUP BY ALL"),
        (
            "vecs",
            "SELECT d.batch, d.id, d.y, p.pos, CASE WHEN len(d.tokens) = 0 THEN 0.0::DOUBLE ELSE "
            f"coalesce(s, 0.0::DOUBLE) / len(d.tokens) END AS x FROM {docs} d CROSS JOIN "
            f"(SELECT unnest(range({size})) AS pos) p LEFT JOIN ts ON ts.id = d.id AND ts.pos = p.pos",
        ),
    ]


# --- dense vectors ----------------------------------------------------------------------


def embeddings(batches: int = 1, batch: str | None = None, y: str = "label::VARCHAR"):
    """``rows(batch, id, y)`` and ``feats(batch, id, idx, v)``."""
    batch = batch or batch_of("vec_id", "embeddings", batches)
    return [
        ("vectors", f"SELECT {batch} AS batch, vec_id AS id, {y} AS y, embedding FROM embeddings"),
        ("rows", "SELECT batch, id, y FROM vectors"),
        (
            "feats",
            "SELECT batch, id, unnest(range(len(embedding))) AS idx, "
            "unnest(embedding)::DOUBLE AS v FROM vectors",
        ),
    ]


def margins(state: str = "state", labels: str = "l_all", cfg: FtrlConfig = CFG):
    """Blocks ``w`` and ``margins(id, y, label, ord, m)`` of all rows under a state."""
    return [
        ("w", f"SELECT label, idx, z, n, {weight('z', 'n', cfg)} AS w FROM {state}"),
        (
            "margins",
            f"SELECT r.id, r.y, l.label, l.ord, coalesce(s.m, 0.0) AS m FROM rows r "
            f"CROSS JOIN {labels} l LEFT JOIN (SELECT f.id, w.label, sum(f.v * w.w) AS m FROM feats f "
            f"JOIN w ON w.idx = f.idx GROUP BY f.id, w.label) s ON s.id = r.id AND s.label = l.label",
        ),
        (
            "best",
            "SELECT id, y, label AS pred, 1.0::DOUBLE / (1.0::DOUBLE + exp(-m)) AS prob FROM margins "
            "QUALIFY row_number() OVER (PARTITION BY id ORDER BY m DESC, ord) = 1",
        ),
    ]


def trained(
    before: list[tuple[str, str]],
    passes: int,
    index_type: str = "BIGINT",
    start: str | None = None,
    labels: str = "SELECT y AS label, row_number() OVER (ORDER BY y) - 1 AS ord FROM (SELECT DISTINCT y FROM rows)",
    cfg: FtrlConfig = CFG,
) -> list[tuple[str, str]]:
    """Blocks of one batch: ``l_all``, the states ``t1``..``tN``, and ``state``."""
    ctes = [*before, ("l_all", labels)]
    ctes.append(empty_state(index_type) if start is None else ("s0", start))
    state = "s0"
    for k in range(1, passes + 1):
        ctes += ftrl_pass(f"t{k}", "feats", "rows", "l_all", state, cfg)
        state = f"t{k}"
    ctes.append(("state", f"SELECT * FROM {state}"))
    return ctes


def _pass_loss(k: int, state: str) -> str:
    loss = r6("avg(CASE WHEN y = label THEN ln(1 + exp(-m)) ELSE ln(1 + exp(-m)) + m END)")
    return (
        f"SELECT label, {k}::INTEGER AS pass, {loss} AS loss FROM (SELECT r.y, l.label, coalesce(s.m, 0.0::DOUBLE) AS m "
        f"FROM rows r CROSS JOIN l_all l LEFT JOIN (SELECT f.id, p.label, sum(f.v * {weight('p.z', 'p.n')}) AS m "
        f"FROM feats f JOIN {state} p ON p.idx = f.idx GROUP BY f.id, p.label) s ON s.id = r.id AND s.label = l.label) "
        "GROUP BY label"
    )


# the mean loss of each label under the state that each pass starts from
PASS_LOSSES = "\n" + "\nUNION ALL ".join(_pass_loss(k, state) for k, state in ((1, "s0"), (2, "t1"), (3, "t2")))

STATE = (
    f"\nSELECT label, idx, {r6('z')} AS z, {r6('n')} AS n, {r6(weight('z', 'n'))} AS w FROM state"
)


# --- gradient descent -------------------------------------------------------------------


def sgd(
    iterations: int,
    step: float,
    reg: float = 0.01,
    tol: float = 0.001,
    loss: str = "logistic",
    rows: str = "targets",
    feats: str = "x",
    start: str | None = None,
    name: str = "w",
    fraction: float | None = None,
    seed: int = 42,
) -> list[tuple[str, str]]:
    """Blocks ``{name}0``..``{name}N(m, pos, w, done)`` for rows(id, m, t) and feats(id, pos, x).

    With ``fraction``, step t takes the rows of which the digest of seed + t and id is below it.
    """
    start = start or (
        f"SELECT m, pos, 0.0::DOUBLE AS w, false AS done FROM (SELECT DISTINCT m FROM {rows}) "
        f"CROSS JOIN (SELECT DISTINCT pos FROM {feats})"
    )
    ctes = [(f"{name}0", start)]
    slope = (
        "1.0::DOUBLE / (1.0::DOUBLE + exp(-g.mg)) - g.t"
        if loss == "logistic"
        else "CASE WHEN (2 * g.t - 1) * g.mg < 1 THEN -(2 * g.t - 1) ELSE 0.0::DOUBLE END"
    )
    for t in range(1, iterations + 1):
        rate = f"({step}::DOUBLE / sqrt({t}::DOUBLE))"
        digest = f"('0x' || substr(md5('{seed + t}-' || r.id), 1, 8))::BIGINT::DOUBLE"
        taken = "" if fraction is None else f" WHERE {digest} < {fraction}::DOUBLE * 4294967296.0::DOUBLE"
        ctes += [
            (
                f"{name}m{t}",
                f"SELECT r.id, r.m, any_value(r.t) AS t, sum(f.x * w.w) AS mg FROM {rows} r "
                f"JOIN {feats} f ON f.id = r.id JOIN {name}{t - 1} w ON w.m = r.m AND w.pos = f.pos"
                f"{taken} GROUP BY r.id, r.m",
            ),
            (
                f"{name}g{t}",
                f"SELECT g.m, f.pos, sum(f.x * ({slope})) / count(*) AS g FROM {name}m{t} g "
                f"JOIN {feats} f ON f.id = g.id GROUP BY g.m, f.pos",
            ),
            (
                f"{name}u{t}",
                f"SELECT w.m, w.pos, w.w AS old, w.done, w.w * (1 - {rate} * {reg}::DOUBLE) - {rate} * g.g "
                f"AS new FROM {name}{t - 1} w JOIN {name}g{t} g ON g.m = w.m AND g.pos = w.pos",
            ),
            (
                f"{name}{t}",
                f"SELECT m, pos, CASE WHEN done THEN old ELSE new END AS w, done OR ({t} > 1 AND "
                f"sqrt(sum((new - old) * (new - old)) OVER (PARTITION BY m)) < {tol}::DOUBLE * "
                f"greatest(sqrt(sum(new * new) OVER (PARTITION BY m)), 1.0::DOUBLE)) AS done "
                f"FROM {name}u{t}",
            ),
        ]
    return ctes


DENSE_X = (
    "x",
    "SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x "
    "FROM embeddings",
)
