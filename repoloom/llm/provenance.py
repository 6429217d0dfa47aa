"""Tell hand-written source from generated, minified, vendored and data files (problem 4).

Each file gives evidence for five labels from its name, header comment and shape; each directory gives some from its
name. Belief propagation over the directory tree of a project combines them: files and directories are the nodes,
parent and child (and through their parent, siblings) are compatible to the degree of two tables. The messages of the
files of a directory are summed before the shuffle; the tree of directories is passed once up and once down, whole
subtrees in memory where they are small, else a level at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.session import materialise, once, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
_N = len(LABELS)

#: Directory names and the label they speak for. Fixed values.
DIRECTORIES = {
    "generated": ("generated", "__generated__", "gen-src", "autogen", "gen", "_generated", "generated-src", "generated-sources", "codegen-out", "autogenerated"),
    "minified": ("dist", "min", "minified"),
    "vendored": ("node_modules", "bower_components", "site-packages", "vendor", "_vendor", "vendored", "third_party", "thirdparty", "third-party", "external", "externals", "extern", "deps", "jspm_packages", "pods", "godeps"),
}
#: Log odds that a directory's name gives its label: such a name is a definition, not a hint.
NAME_ODDS = 200.0
#: Names that are used for other things as well, with lesser odds.
WEAK_NAMES, WEAK_ODDS = ("dist", "min", "minified", "gen", "deps", "external", "externals", "extern", "pods"), 12.0
#: Log likelihood ratio for hand-written source of a file without any mark of another origin.
ORDINARY = 0.7
#: Probability that a child has the label of a directory that is not hand-written, of one that is, and the prior.
KEEP_FILE, KEEP_HAND_FILE, KEEP_DIR, KEEP_HAND_DIR, PRIOR_HAND = 0.9, 0.7, 0.97, 0.9995, 0.95

#: Directories that are solved in one task at most, and files of a directory from which on its belief is sent to them.
TREE_ROWS, HOT_FILES = 200_000, 1_000_000
#: Log odds for data or minified code where the table's language or line count does not fit the file: hints, no proof.
MISFIT = 0.5
#: Languages of data. Fixed values.
DATA_LANGUAGES = frozenset("json csv xml yaml text txt binary data".split())

_COMMENT_LINE = re.compile(r"(?m)^[ \t]*(?:#|//|--|/\*|\*|<!--|\"\"\")[^\r\n]*")
_COMMENT_HEAD = re.compile(r"\A(?:\s*(?:#[^\n\r]*|//[^\n\r]*|--[^\n\r]*|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?''')[ \t]*(?:\r\n|\n|\r|\Z)*)+", re.S)
#: What the header of a file that a tool made says. Fixed values.
_GENERATED = re.compile(
    r"(?i)\bdo\s+not\s+(?:edit|modify)|@generated\b|<auto-?generated|\bauto-?generated\s+(?:by|file|from|code|with)|\bcode\s+generated\b|\b(?:is|was|been)\s+(?:automatically\s+|auto-?)(?:generated|produced|created)|\bthis\s+file\s+(?:is|was)\s+(?:automatically\s+)?(?:generated|produced)|\bgenerated\s+(?:from|by|with|using|at)\s+\S+.{0,60}\b(?:build|edits?|overwritten|lost|version)|^\W*generated\s+(?:by|from)\s|machine[- ](?:written|generated)|manual\s+(?:edits|changes)\s+(?:are|will)|changes\s+will\s+be\s+(?:lost|overwritten)|automatisch\s+(?:erzeugt|generiert)|nicht\s+bearbeiten|(?:fichier|code)\s+(?:produit|généré|genere)\s+par|ne\s+pas\s+modifier|generado\s+(?:por|automáticamente)|no\s+(?:editar|modificar)\b|edit\s+\S+\s+and\s+run\s+it\s+again"
)
_NOT_GENERATED = re.compile(r"(?i)\bthis\s+(?:module|script|class|code|tool|function)\s+(?:generates|emits|writes|produces|creates)|\b(?:not|never|isn't|no\s+longer)\s+(?:auto-?)?generated|hand-?written")
#: What the header of a copy of somebody else's file says. Fixed values.
_VENDORED = re.compile(
    r"(?i)\bvendored\s+(?:from|copy)|\bcopied\s+(?:verbatim\s+)?from\b.{0,80}\b(?:distribution|release|repository|upstream|project|package)|\bimported\s+from\s+\S+@\d|see\s+third-party\s+notices|\bupstream:\s*\S|\|\s*\(c\)\s|\(c\)\s+(?:the\s+)?[\w-]+\s+(?:authors|contributors|developers|foundation)|copyright\s+\(c\).{0,80}\b(?:authors|contributors|foundation|inc\b)|\blicensed\s+under\s+(?:the\s+)?(?:mit|bsd|apache|mpl|gpl|lgpl|isc|zlib)|released\s+under\s+(?:the\s+)?\w+\s+licen[cs]e"
)
_VERSIONED = re.compile(r"(?i)^[a-z][a-z0-9_.]*-v?\d+\.\d+(?:\.\d+)*(?:[-.](?:min|bundle|prod))*\.\w+$")
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|js)|\.g\.\w+|\.generated\.\w+|\.gen\.\w+|[._-]autogen\.\w+|\.designer\.\w+|_generated\.\w+|_gen\.\w+|Grpc\.java|OuterClass\.java)$")
_MINIFIED_NAME = re.compile(r"(?i)[._-]min\.(?:js|css|mjs)$|\.bundle\.js$")
_CODE = re.compile(r"(?i)\.(?:py|js|mjs|cjs|jsx|ts|tsx|java|sql|go|rb|php|c|cc|cpp|h|cs|rs|kt|swift|scala|css)$")
_WORD = re.compile(r"[A-Za-z_]\w*")
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|-?\b(?:0x[0-9a-fA-F]+|\d[\d._eE+-]*)\b|[\[\](),\s{}]+")
_VALUE = re.compile(r"\b(?:0x[0-9a-fA-F]+|\d[\d.]*)\b|\"[^\"\n]{0,200}\"|'[^'\n]{0,200}'")
_QUOTED = re.compile(r"\"\"\".*?\"\"\"|'\'\'.*?'\'\'|`[^`]*`|\"[^\"\n]*\"|'[^'\n]*'", re.S)
_DIGITS = re.compile(r"\d+")
_LINE = re.compile(r"\r\n|\n|\r")


def evidence(path: str, content: str, lines_of_code: int | None = None, language: str | None = None) -> list[float]:
    """Log likelihoods of the five labels from one file's name, header and shape; zeros say nothing.

    What the table says about language and lines is often wrong: it only adds to evidence that the content gives.
    """
    out = [0.0] * _N
    hand, generated, minified, vendored, blob = range(_N)
    name = path.rsplit("/", 1)[-1]
    lines = [x for x in _LINE.split(content) if x.strip()]
    size = len(content)
    code = bool(_CODE.search(name))
    head = _COMMENT_HEAD.match(content)
    top = "\n".join([head[0] if head else "", *_COMMENT_LINE.findall(content.replace("\r", "\n"))])
    if _GENERATED.search(_NOT_GENERATED.sub("", top)):
        out[generated] += 9
    if _VENDORED.search(top):
        out[vendored] += 9
    if _VERSIONED.search(name):
        out[vendored] += 7
    if _GENERATED_NAME.search(name):
        out[generated] += 7
    if _MINIFIED_NAME.search(name):
        out[minified] += 7
    if not lines or not code:
        if not any(out):
            out[hand] += ORDINARY
        return out
    body = content[head.end() :] if head else content
    rows = [x for x in _LINE.split(body) if x.strip()] or lines
    # minified: few, long lines with hardly any white space, made of short names
    longest = max(map(len, rows))
    blanks = sum(body.count(c) for c in " \t") / max(1, len(body))
    marks = sum(body.count(c) for c in "{}();,=") / max(1, len(body))
    if longest > 200 and blanks < 0.09 and marks > 0.12 and len(body) > 300 and re.search(r"[{};]", body):
        names = short = 0
        for m in _WORD.finditer(body):
            names += 1
            short += m.end() - m.start() <= 3
        if short > 0.3 * names:
            out[minified] += 8
    if re.search(r"(?m)^//# sourceMappingURL=", content) and len(rows) <= 6:
        out[minified] += 3
    # data: most of the text is literals in rows of one form
    literal = 1 - len(_LITERAL.sub("", body)) / max(1, len(body))
    numbers = len(_VALUE.findall(body)) if literal > 0.75 else 0
    quoted = max(map(len, _QUOTED.findall(body)), default=0)
    if literal > 0.85 and numbers >= 40 or quoted > max(1000, 0.7 * len(body)):
        out[blob] += 8
    elif literal > 0.75 and numbers >= 100:
        out[blob] += 6
    # generated: the same lines over and over, differing in a counter only
    if len(rows) >= 12:
        skeletons = Counter(x.strip() for x in _DIGITS.sub("9", "\n".join(rows)).split("\n"))
        counted = sum(n for s, n in skeletons.items() if "9" in s and n >= 8 and len(s) > 12 and re.search(r"[A-Za-z]", s))
        if counted / len(rows) > 0.4 and out[blob] == 0 and _counts_up(rows):
            out[generated] += 7
    if out[blob] and (language or "").strip().lower() in DATA_LANGUAGES:
        out[blob] += MISFIT
    if out[minified] and lines_of_code and size > 400 * lines_of_code > 0:
        out[minified] += MISFIT
    if not any(out):
        out[hand] += ORDINARY
    return out


def _counts_up(rows: list[str]) -> bool:
    """Whether rows of one form count up in the digits of a name, as tools number what they emit."""
    last: dict[str, int] = {}
    up = total = 0
    for row in rows:
        m = re.search(r"[A-Za-z_](\d+)\b", row)
        if m:
            key = re.sub(r"\d+", "9", row.strip())
            n = int(m[1])
            if key in last:
                total += 1
                up += n == last[key] + 1
            last[key] = n
    return total >= 8 and up / total > 0.7


def _table(keep: float, keep_hand: float) -> list[list[float]]:
    """Log compatibility [parent][child]."""
    out = []
    for parent in range(_N):
        stay = keep_hand if parent == 0 else keep
        rest = (1 - stay) / (_N - 1)
        out.append([math.log(stay if child == parent else rest) for child in range(_N)])
    return out


_FILE_TABLE, _DIR_TABLE = np.array(_table(KEEP_FILE, KEEP_HAND_FILE)), np.array(_table(KEEP_DIR, KEEP_HAND_DIR))


def _through(values: np.ndarray, table: np.ndarray, upward: bool) -> np.ndarray:
    """Messages (rows, labels) over an edge: from child to parent if ``upward``, else from parent to child."""
    terms = values[:, :, None] + (table.T if upward else table)[None]
    top = terms.max(1)
    return top + np.log(np.exp(terms - top[:, None, :]).sum(1))


def _evidence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, projects, paths, lines, languages, contents = (batch.column(i).to_pylist() for i in range(6))
        rows = [evidence(p or "", c, n, x) if c else [0.0] * _N for p, n, x, c in zip(paths, lines, languages, contents, strict=True)]
        cases = [bool(c) for c in contents]
        own = np.array(rows).reshape(-1, _N)
        message = _through(own, _FILE_TABLE, True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([p or "" for p in projects]), pa.array([p or "" for p in paths]), pa.array(cases), *(pa.array(own[:, k]) for k in range(_N)), *(pa.array(message[:, k]) for k in range(_N))],
            names=["file_id", "project_id", "path", "has_content", *(f"e{k}" for k in range(_N)), *(f"m{k}" for k in range(_N))],
        )


def _matrix(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    return np.stack([batch.column(f"{prefix}{k}").to_numpy(zero_copy_only=False) for k in range(_N)], 1)


def _rising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directories with the sum of what lies below them: adds the message to the parent, none from an island."""
    for batch in batches:
        message = _through(_matrix(batch, "u"), _DIR_TABLE, True)
        message[np.array(batch.column("island").to_pylist(), bool)] = 0
        yield pa.RecordBatch.from_arrays([batch.column("project_id"), batch.column("dir"), *(batch.column(f"u{k}") for k in range(_N)), *(pa.array(message[:, k]) for k in range(_N))], names=["project_id", "dir", *(f"u{k}" for k in range(_N)), *(f"m{k}" for k in range(_N))])


def _falling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directories joined with their parents' beliefs: the belief of each."""
    for batch in batches:
        belief = _matrix(batch, "u") + _through(_matrix(batch, "b") - _matrix(batch, "m"), _DIR_TABLE, False)
        yield pa.RecordBatch.from_arrays([batch.column("project_id"), batch.column("dir"), *(pa.array(belief[:, k]) for k in range(_N))], names=["project_id", "dir", *(f"b{k}" for k in range(_N))])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files joined with their directories' beliefs: the likeliest label and its probability."""
    for batch in batches:
        final = _matrix(batch, "e") + _through(_matrix(batch, "b") - _matrix(batch, "m"), _FILE_TABLE, False)
        share = np.exp(final - final.max(1, keepdims=True))
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array([LABELS[k] for k in final.argmax(1)], pa.string()), pa.array(share.max(1) / share.sum(1))], names=["file_id", "label", "confidence"])


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in range(_N)]


_ROOT = np.log([PRIOR_HAND if k == 0 else (1 - PRIOR_HAND) / (_N - 1) for k in range(_N)])
_BY_NAME = {name: LABELS.index(label) for label, names in DIRECTORIES.items() for name in names}


def _name_evidence(directory: Column) -> list[Column]:
    name = F.lower(F.element_at(F.split(directory, "/"), -1))
    odds = F.when(name.isin(*WEAK_NAMES), F.lit(WEAK_ODDS)).otherwise(F.lit(NAME_ODDS))
    return [F.when(name.isin(*DIRECTORIES[label]), odds).otherwise(F.lit(0.0)) if label in DIRECTORIES else F.lit(0.0) for label in LABELS]


class _Tree:
    """Directories of whole subtrees from the depth ``floor`` on, in memory, with the sums of what lies below them."""

    def __init__(self, rows: pa.Table, floor: int) -> None:
        keys = list(zip(*(rows.column(c).to_pylist() for c in ("project_id", "dir", "depth")), strict=True))
        at = {key: i for i, key in enumerate(keys)}
        parents: list[int] = []
        i = 0
        while i < len(keys):  # ancestors without files join the end
            project, directory, depth = keys[i]
            if depth > floor:
                above = (project, directory.rpartition("/")[0], depth - 1)
                if above not in at:
                    at[above] = len(keys)
                    keys.append(above)
                parents.append(at[above])
            else:
                parents.append(-1)
            i += 1
        self.keys, self.parent, self.floor = keys, np.array(parents, np.int64), floor
        self.depth = np.array([k[2] for k in keys], np.int64)
        names = np.zeros((len(keys), _N))
        for i, (_, directory, depth) in enumerate(keys):
            name = directory.rpartition("/")[2].lower()
            if depth == 0:
                names[i] = _ROOT
            elif name in _BY_NAME:
                names[i, _BY_NAME[name]] = WEAK_ODDS if name in WEAK_NAMES else NAME_ODDS
        islands = np.array([k[1].rpartition("/")[2].lower() in _BY_NAME for k in keys], bool)
        self.u, self.m = names, np.zeros((len(keys), _N))
        n = rows.num_rows
        self.u[:n] += np.stack([rows.column(f"m{k}").to_numpy() for k in range(_N)], 1)
        self.levels = [np.flatnonzero(self.depth == d) for d in range(floor, int(self.depth.max(initial=floor)) + 1)]
        for here in self.levels[::-1]:
            message = _through(self.u[here], _DIR_TABLE, True)
            message[islands[here]] = 0
            self.m[here] = message
            if len(here) and self.depth[here[0]] > floor:
                np.add.at(self.u, self.parent[here], message)

    def beliefs(self, above: np.ndarray | None = None) -> np.ndarray:
        """The beliefs of all directories; ``above`` are those of the parents of the ones at the floor."""
        out = np.empty_like(self.u)
        for no, here in enumerate(self.levels):
            if no or above is not None:
                parents = out[self.parent[here]] if no else above
                out[here] = self.u[here] + _through(parents - self.m[here], _DIR_TABLE, False)
            else:
                out[here] = self.u[here]
        return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The beliefs of the directories of whole projects."""
    batches = list(batches)
    if batches:
        tree = _Tree(pa.Table.from_batches(batches), 0)
        b = tree.beliefs()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tree.keys], pa.string()), pa.array([k[1] for k in tree.keys], pa.string()), *(pa.array(b[:, k]) for k in range(_N))], names=["project_id", "dir", *(f"b{k}" for k in range(_N))])


def _subtrees(floor: int):  # noqa: ANN202 - a function of batches
    """The messages that the subtrees at ``floor`` send to their parents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            tree = _Tree(pa.Table.from_batches(batches), floor)
            top = tree.levels[0]
            yield pa.RecordBatch.from_arrays([pa.array([tree.keys[i][0] for i in top], pa.string()), pa.array([tree.keys[i][1].rpartition("/")[0] for i in top], pa.string()), *(pa.array(tree.m[top, k]) for k in range(_N))], names=["project_id", "dir", *(f"m{k}" for k in range(_N))])

    return run


def _subtree_beliefs(floor: int):  # noqa: ANN202 - a function of batches
    """The beliefs of the directories of subtrees; every row has the belief of the parent of its subtree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            rows = pa.Table.from_batches(batches)
            tree = _Tree(rows, floor)
            known = {}
            for project, root, *b in zip(*(rows.column(c).to_pylist() for c in ("project_id", "root", *(f"b{k}" for k in range(_N)))), strict=True):
                known[project, root] = b
            above = np.array([known[tree.keys[i][:2]] for i in tree.levels[0]]).reshape(-1, _N)
            b = tree.beliefs(above)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tree.keys], pa.string()), pa.array([k[1] for k in tree.keys], pa.string()), *(pa.array(b[:, k]) for k in range(_N))], names=["project_id", "dir", *(f"b{k}" for k in range(_N))])

    return run


def _numbers(*prefixes: str) -> str:
    return ", ".join(f"{x}{k} double" for x in prefixes for k in range(_N))


_KEY = "project_id string, dir string"


def _beliefs(below: DataFrame, levels: dict[int, int], tree_rows: int) -> DataFrame:
    """``project_id, dir, b0..`` of every directory. ``levels``: how many directories of each depth hold files.

    Subtrees at a depth below which there are few directories (``tree_rows`` at most, ancestors counted) are solved in
    memory; above it each level is one aggregation on the way up and one join on the way down, and is written once.
    """
    deepest = max(levels, default=0)
    floor, size = deepest + 1, 0
    behind = 0
    while floor > 0:
        behind += levels.get(floor - 1, 0)
        size += behind  # each directory may add an ancestor at each depth
        if size > tree_rows:
            break
        floor -= 1
    spark = below.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    if floor == 0:
        return below.repartition(tasks, "project_id").mapInArrow(_whole, f"{_KEY}, {_numbers('b')}")
    root = lambda depth: F.substring_index("dir", "/", depth) if depth else F.lit("")
    tail = below.where(F.col("depth") >= floor).withColumn("root", root(floor)).repartition(tasks, "project_id", "root")
    rising = tail.mapInArrow(_subtrees(floor), f"{_KEY}, {_numbers('m')}") if floor <= deepest else None
    summed = [F.sum(f"m{k}").alias(f"u{k}") for k in range(_N)]
    up: dict[int, DataFrame] = {}
    for depth in range(floor - 1, -1, -1):
        here = below.where(F.col("depth") == depth).select("project_id", "dir", *_cols("m"))
        if rising is not None:
            here = here.unionByName(rising)
        level = here.groupBy("project_id", "dir").agg(*summed)
        names = _name_evidence(F.col("dir")) if depth else [F.lit(float(x)) for x in _ROOT]
        level = level.select("project_id", "dir", *[(u + n).alias(f"u{k}") for k, (u, n) in enumerate(zip(_cols("u"), names, strict=True))])
        # a directory that is named for what it holds says nothing about its parent
        level = level.withColumn("island", F.greatest(*_name_evidence(F.col("dir"))) > 0).mapInArrow(_rising, f"{_KEY}, {_numbers('u', 'm')}")
        up[depth] = level = materialise(level, f"p4-up{depth}")
        rising = level.select("project_id", F.regexp_replace("dir", r"/?[^/]*$", "").alias("dir"), *_cols("m"))
    above = up[0].select("project_id", "dir", *[F.col(f"u{k}").alias(f"b{k}") for k in range(_N)])
    beliefs = above
    for depth in range(1, floor):
        parents = above.select("project_id", F.col("dir").alias("parent"), *_cols("b"))
        level = up[depth].withColumn("parent", F.regexp_replace("dir", r"/?[^/]*$", "")).join(parents, ["project_id", "parent"])
        above = materialise(level.mapInArrow(_falling, f"{_KEY}, {_numbers('b')}"), f"p4-down{depth}")
        beliefs = beliefs.unionByName(above)
    if floor <= deepest:
        parents = above.select("project_id", F.col("dir").alias("parent"), *_cols("b"))
        joined = tail.withColumn("parent", F.regexp_replace("root", r"/?[^/]*$", "")).join(parents, ["project_id", "parent"]).repartition(tasks, "project_id", "root")
        beliefs = beliefs.unionByName(joined.mapInArrow(_subtree_beliefs(floor), f"{_KEY}, {_numbers('b')}"))
    return beliefs


def labels(files: DataFrame, tree_rows: int = TREE_ROWS, hot_files: int = HOT_FILES) -> DataFrame:
    """``file_id, label, confidence`` of each file with content, one row per file however often it was delivered.

    Files whose content is null or empty have no label and give no row; they count in the tree as files that say
    nothing. A null path counts as a file of the project's root, a leading or doubled slash does not count, a null project as a project of its own; files with a
    null id are all judged and kept. ``tree_rows``: see :func:`_beliefs`. A directory with more than ``hot_files`` files
    and a thousandth of all, of which there are fewer than a thousand, gives its belief to its files where they lie.
    """
    source = spread(files.select("file_id", "project_id", "path", F.col("lines_of_code").cast("int").alias("lines_of_code"), "language", "content"), "file_id")
    leaves = once(source.mapInArrow(_evidence_rows, f"file_id bigint, project_id string, path string, has_content boolean, {_numbers('e', 'm')}"), "file_id")
    leaves = leaves.withColumn("dir", F.trim(F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), "/+", "/"), F.lit("/"))).withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))).drop("path")
    leaves = materialise(leaves, "p4-leaves")
    below = leaves.groupBy("project_id", "dir", "depth").agg(F.count("*").alias("n"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(_N)])
    below = materialise(below, "p4-dirs")
    levels = below.groupBy("depth").agg(F.count("*").alias("dirs"), F.sum("n").alias("files"), F.max("n").alias("most")).collect()  # one row per depth
    beliefs = _beliefs(below, {r.depth: r.dirs for r in levels}, tree_rows)
    wanted = leaves.where("has_content")
    hot = max(hot_files, sum(r.files for r in levels) // 1000)
    schema = "file_id bigint, label string, confidence double"
    if max((r.most for r in levels), default=0) <= hot:
        return wanted.join(beliefs, ["project_id", "dir"]).mapInArrow(_labelled, schema)
    beliefs = materialise(beliefs, "p4-beliefs")
    few = beliefs.join(F.broadcast(below.where(F.col("n") > hot).select("project_id", "dir")), ["project_id", "dir"])
    told = wanted.join(F.broadcast(few), ["project_id", "dir"], "left")
    rest = told.where("b0 is null").drop(*[f"b{k}" for k in range(_N)]).join(beliefs, ["project_id", "dir"])
    return told.where("b0 is not null").mapInArrow(_labelled, schema).unionByName(rest.mapInArrow(_labelled, schema))


def found(files: DataFrame) -> DataFrame:
    """``file_id`` of each file that is not hand-written source."""
    return labels(files).where(F.col("label") != LABELS[0]).select("file_id")
