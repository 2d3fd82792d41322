"""The command line over a small tree."""

import os

import pytest

from codequarry.__main__ import run


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    os.makedirs(root / "lib")
    (root / "lib/store.ex").write_text("defmodule Store do\n  def fetch(id), do: id\nend\n")
    (root / "lib/shop.ex").write_text("defmodule Shop do\n  defdelegate fetch(id), to: Store\n\n  def run, do: Store.fetch(1)\nend\n")
    return root


def test_commands(spark, tree):
    index = ["--index", str(tree / "idx")]
    ask = lambda *words: run(spark, [*words, *index])
    assert ask("init", str(tree)) == (0, ["2 files, 5 definitions, 2 references"])
    assert ask("init", str(tree))[0] == 1
    assert ask("init", str(tree), "--force")[0] == 0
    store, shop = str(tree / "lib/store.ex"), str(tree / "lib/shop.ex")
    assert ask("lookup", "Store", "fetch") == (0, [f"{store}:2"]) and ask("lookup", "Store") == (0, [f"{store}:1"])
    assert ask("lookup", "Shop", "fetch") == (0, [f"{store}:2"])
    assert ask("lookup", "Shop", "fetch", "--no-follow-delegates") == (0, [f"{shop}:2"])
    assert ask("lookup", "Shop", "none") == (0, [f"{shop}:1"]) and ask("lookup", "Shop", "none", "--strict") == (1, [])
    assert ask("references", "Store", "fetch") == (0, [f"{shop}:4"]) and ask("references", "Nowhere") == (1, [])
    (tree / "lib/store.ex").write_text("\n\ndefmodule Store do\n  def fetch(id), do: id\nend\n")
    assert ask("reindex", store)[0] == 0 and ask("lookup", "Store", "fetch") == (0, [f"{store}:4"])
    os.remove(shop)
    assert ask("reindex", str(tree))[1] == ["2 files, 5 definitions, 2 references"]
    assert ask("reindex", str(tree), "--prune")[1] == ["1 files, 2 definitions, 0 references"]
    assert run(spark, ["version"])[0] == 0
