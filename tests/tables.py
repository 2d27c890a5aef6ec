"""Small tables of our own in each layout."""

import os

T1 = [("a1b2c3d4", "70", "300"), ("B2c3d4e5", "cb", "400"), ("c3d4e5f6", "5F", "200"), ("d4e5f6a7", "f8", "900"), ("e5f6a7b8", "6c", "700")]
T2 = [("B2C3D4E5", "x1", "400"), ("ffff0000", "x2", "300"), ("d4e5f6a7  ", "x3", "900"), ("d4e5f6a7", "x4", "901")]
T3 = [("k1", "ae", "7"), ("k2", "cd", "19"), ("k3", "CD ", "83"), ("k4", "cd", "20"), ("k5", "e0", "95"), ("k6", "AE", "38")]


def write(folder) -> str:
    folder = str(folder)

    def put(name: str, header: str | None, rows, sep: str) -> None:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            for r in ([header.split(",")] if header else []) + [list(x) for x in rows]:
                f.write(sep.join(r) + "\n")

    put("t1.tsv", "foo,bar,baz", T1, "\t")
    put("t2.csv", "foo,bar,baz", T2, ",")
    put("t3.psv", "foo,bar,baz", T3, "|")
    put("t4.tsv", "foo,bar,foo", [("1", "2", "3")], "\t")
    put("short.csv", "a,b,c", [("1",), ("2", ""), ("", "x", ""), ("4", "y", "z", "w")], ",")
    put("bare.txt", None, [("1", "Joe", "61"), ("2", "Jane", "77")], "\t")
    put("grades.csv", "id,name,grade", [("1", "Joe", "55"), ("2", '"Ann, ""A"""', "88"), ("3", '"two\nlines"', "")], ",")
    put("fixed.txt", None, [("alpha 1234",), ("beta  5678",)], "")
    put("wide.schema", None, [("name", "6", "c"), ("num", "4", "c"), ("eor", "1", "c")], ",")
    put("solid.schema", None, [("a", "2", "c"), ("b", "3", "c")], ",")
    with open(os.path.join(folder, "solid.dat"), "w") as f:
        f.write("ab123cd456")
    put("broken.schema", None, [("a", "2", "c"), ("b",)], ",")
    put("empty.csv", "foo,bar", [], ",")
    with open(os.path.join(folder, "Case.TXT"), "w") as f:
        f.write("x\n1\n")
    return folder
