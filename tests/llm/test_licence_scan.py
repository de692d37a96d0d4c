from passagework.llm.licence_scan import licence_scan
from passagework.llm.licences import TEXTS


def test_spellings_and_marks(spark):
    mit = TEXTS["MIT"]
    changed = "\n".join("  # " + x for x in mit.replace("sublicense", "sub-license").replace("Copyright (c) <year> <copyright holders>", "(c) 2020 Somebody\nCopyright 2021 Other").upper().split("\n"))
    rows = [(1, mit, 0), (2, changed, 0), (3, mit + " more", 0), (4, None, 0), (5, "...", 0), (None, "some text\nReleased under the  MIT licence!\nlicensed under cc by-nc 4.0", 1), (1, mit, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, digest int")
    got = sorted(str((r.doc_id, r.licence, r.notices, r.digest is None)) for r in licence_scan(docs).collect())
    want = [(1, "MIT", [], False), (1, "MIT", [], False), (2, "MIT", [], False), (3, None, [], False), (4, None, [], True), (5, None, [], True), (None, None, ["CC-BY-NC-4.0", "MIT"], False)]
    assert got == sorted(map(str, want))
    assert licence_scan(docs.limit(0)).count() == 0
