"""Corpus preparation operators for language-model training data; nothing else in the package imports this."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, lattice, line_dedup, linkgraph, minhash, packing, pii, quality, secret_scan, vptree

    fs = (
        bpe.op1_bpe_roundtrip,
        pii.op2_context_pii,
        secret_scan.op3_markov_secrets,
        vptree.op4_vp_tree,
        line_dedup.op5_fuzzy_lines,
        minhash.op6_minhash_join,
        linkgraph.op7_link_trust,
        packing.op8_harmonic_packing,
        quality.op9_isolation_rules,
        lattice.op10_lattice_likelihood,
    )
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    from . import minhash, vptree

    return {"op4_vp_tree": vptree.ORACLE, "op6_minhash_join": minhash.ORACLE}
