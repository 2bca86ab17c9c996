from __future__ import annotations

import pytest

from gritstone.functions.attributes import Attributes

FILES = [
    (".gitattributes", '# top\n[attr]made linguist-generated -diff\ngen/** made\n*.lock linguist-vendored=true\n"my dir/*" linguist-generated\n*.bin binary\nx.py linguist-generated=false\n"tab\\tname" linguist-vendored\n\n*.only\n'),
    ("gen/keep/.gitattributes", "*.py -linguist-generated\n/b.py linguist-generated=true\nc.py !linguist-generated\n[attr]mine linguist-vendored\n*.q mine\n"),
]


@pytest.mark.parametrize(
    ("path", "generated", "vendored"),
    [
        ("gen/a.py", True, None), ("gen/keep/a.py", False, None), ("gen/keep/b.py", True, None), ("gen/keep/c.py", None, None), ("gen/keep/deep/b.py", False, None), ("yarn.lock", None, True), ("a/b/yarn.lock", None, True),
        ("my dir/a", True, None), ("my", None, None), ("my dir/a/b", None, None), ("x.py", False, None), ("tab\tname", None, True), ("gen/keep/a.q", True, None), ("other.py", None, None), ("agen", None, None),
    ],
)
def test_states(path, generated, vendored):
    got = Attributes(FILES).of(path)
    assert (got.get("linguist-generated"), got.get("linguist-vendored")) == (generated, vendored)


def test_macros_and_order():
    a = Attributes(reversed(FILES))
    assert a.states("x.bin") == {"binary": True, "diff": False, "merge": False, "text": False}
    assert a.states("gen/a.py") == {"made": True, "linguist-generated": True, "diff": False}
    assert Attributes([(".gitattributes", "[attr]a b\n[attr]b a\n* a\n"), ("s/.gitattributes", None)]).states("s/x") == {"a": True, "b": True}
    assert Attributes([]).states("x") == {}
