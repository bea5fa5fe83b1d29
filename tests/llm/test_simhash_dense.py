"""Groups of near copies: linked without comparing all pairs, and with the same components."""

import numpy as np
import pytest

from lodestone.llm import shared, simhash


def near_copies(rng, n, spots, chance, bases=1):
    """Fingerprints that differ from one of a few in some of the bits ``spots``."""
    base = rng.integers(0, 2**63, bases).astype(np.uint64)
    flips = (rng.random((n, len(spots))) < chance).astype(np.uint64) << np.array(spots, np.uint64)
    return np.unique(base[rng.integers(0, bases, n)] ^ np.bitwise_or.reduce(flips, axis=1))


def smallest_reachable(nodes, distance):
    label, near = np.arange(len(nodes)), np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= distance
    while True:
        least = np.where(near, label[None, :], len(nodes)).min(axis=1)
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize("bits, chance", [(9, 0.5), (17, 0.5), (12, 0.2), (30, 0.2), (40, 0.5)])
def test_labels_against_all_pairs(bits, chance):
    rng = np.random.default_rng(bits)
    nodes = near_copies(rng, 900, rng.choice(64, bits, replace=False), chance, 3)
    for distance in (0, 1, 2, 4):
        assert (simhash.link_labels(nodes, np.ones(len(nodes), bool), distance) == smallest_reachable(nodes, distance)).all()


def test_links_between_replicas_alone_are_left_to_their_homes():
    nodes = np.array([0b0, 0b111, 0xFFFF << 40], np.uint64)
    assert simhash.link_labels(nodes, np.array([False, False, True]), 4).tolist() == [0, 1, 2]
    assert simhash.link_labels(nodes, np.array([False, True, False]), 4).tolist() == [0, 0, 2]


def test_blocks_of_near_copies_share_out_the_bits_that_differ():
    """Of 64 bits 20 differ: whichever blocks are equal, rows of a choice are few; and a linked pair agrees in one."""
    rng = np.random.default_rng(3)
    nodes = near_copies(rng, 20_000, range(20, 40), 0.5)
    ones = np.array([int((nodes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)])
    masks = simhash.cuts(len(nodes), ones, 4, 1000)
    largest = max(int(np.unique(nodes & np.uint64(m), return_counts=True)[1].max()) for m in masks)
    assert largest <= 2000
    for _ in range(300):
        value = int(rng.integers(0, 2**63))
        other = value
        for b in rng.choice(64, 4, replace=False):
            other ^= 1 << int(b)
        assert any(value & m == other & m for m in masks)


def test_components_of_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 100)
    rng = np.random.default_rng(11)
    nodes = np.concatenate([near_copies(rng, 1500, range(8, 42, 2), 0.5), near_copies(rng, 300, range(64), 0.06)])
    nodes = np.unique(nodes)
    frame = spark.createDataFrame([(int(f), int(f)) for f in nodes.view(np.int64)], "id long, fp long")
    got = {r.node: r.component for r in shared.components(simhash.links(frame)).collect()}
    label = smallest_reachable(nodes, 4)
    assert len(np.unique(label)) > 3
    for k in np.unique(label):
        own = nodes.view(np.int64)[label == k]
        assert {got.get(int(f), int(f)) for f in own} == {int(own.min())}
