import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fjordlake.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows, arity=2):
    """doc_id, leaf, subroot, root, digest of the proof, folded root, in order of the tree."""

    def leaf(r, count):
        values = (r[0], r[1], r[2], count, r[4])
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, i in zip(paths, at):
                a = i - i % arity
                path.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + arity])))
            at = [i // arity for i in at]
            nodes = [digest(*nodes[a : a + arity]) for a in range(0, len(nodes), arity)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in langs:
        ordered = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[3])))
        inner[lang] = ordered, *tree([leaf(r, r[3]) for r in ordered])
    root, tops = tree([inner[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        ordered, subroot, paths = inner[lang]
        for r, path in zip(ordered, paths):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, r[3] + 1 if hit else r[3])
            for a, b in path + top:
                node = digest(a, node, b)
            out.append((r[0], leaf(r, r[3]), subroot, root, digest(*(a + b for a, b in path + top)), node))
    return sorted(out, key=repr)


def got(frame, **options):
    rows = M.merkle_manifest(frame, also={"other": M.tampered(frame)}, **options)
    proof = M.proof_digest(F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof, M.fold(F.col("other"), F.col("proof")))
    return sorted(map(tuple, rows.collect()), key=repr)


def table(n, langs):
    rows = [(i * 3 % 1000, f"s{i % 4}" if i % 5 else None, langs[i % len(langs)], None if i % 11 == 0 else i, f"tëxt {i}" if i % 13 else None) for i in range(n)]
    return [r + ("g", "leaf") for r in rows]


@pytest.mark.parametrize("options", [{}, {"top_nodes": 2, "least_height": 1}, {"arity": 3, "top_nodes": 4, "least_height": 2}])
def test_against_brute_force(spark, options):
    rows = table(203, ["en", "de", None, "en", "en", "ü"]) + [(9, "x", "one", 2**63 - 1, "", "", "")]
    rows += [(None, None, None, None, None, None, None)] * 3 + [(7, "s", "en", 7, "again", "", "")] * 40  # repeated rows
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), **options) == brute(rows, options.get("arity", 2))


def test_more_groups_than_the_driver_holds(spark):
    rows = table(120, [f"l{i:02d}" for i in range(40)])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), top_nodes=4, least_height=1) == brute(rows)


def test_one_row_is_its_own_root_and_no_row_is_none(spark):
    rows = [(3, "s", None, 1, "word " * 200_000, "", "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_tampered_rows_do_not_verify(spark):
    rows = table(70, ["en", "de"])
    found = M.verified_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    hit = {r[0] for r in rows if r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r.doc_id for r in found if not r.verified} == hit and len(hit) > 3
