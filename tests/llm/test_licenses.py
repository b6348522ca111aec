from gradeloom.llm.licenses import scan_licenses

ROWS = [
    (1, "Some text.\nReleased under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "mit LICENSE and again: MIT license; apache license"),
    (6, "Plain words about a driver's license and public rights."),
    (7, None),
    (8, ""),
    (1, "Some text.\nReleased under the MIT License."),
    (None, "all rights reserved"),
    (9, "word " * 40_000 + "general public license"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]


def test_notices_and_base_phrases(table):
    got = {r.doc_id: r for r in scan_licenses(table(ROWS)).collect()}
    assert scan_licenses(table(ROWS)).count() == len(ROWS)
    labels = {d: r["labels"] for d, r in got.items()}
    assert labels == {
        1: ["mit"],
        2: ["apache", "apache-2.0"],
        3: ["gpl", "gpl-3.0"],
        4: ["cc-by-nc-4.0"],
        5: ["apache", "mit"],
        6: [],
        7: [],
        8: [],
        None: ["reserved"],
        9: ["gpl"],
        10: ["mit"],
    }
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].last_word) == (8, 3, 0, 6)
    assert (got[9].n_base, got[9].first_word) == (1, 40_000)
    assert (got[6].n_base, got[6].first_word, got[6].score) == (0, None, 0.0)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score > 0.5


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels int")).count() == 0


def test_every_notice_of_a_file_is_found(table):
    notices = [
        "Subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under CC BY 4.0.",
        "All rights reserved.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    wanted = ["bsd", "cc-by-4.0", "mpl-2.0", "reserved"]
    ordinary = "a person obtaining a binary domain may modify the attribution noncommercial redistribution unencumbered affero "
    # Rare words of other notices, alone and out of place; a third of all rows has the same notice.
    rows = [(i, f"Plain text {i}.") for i in range(20)] + [(100 + i, f"Text {i}. {notices[2]}") for i in range(12)]
    rows += [(500, " and ".join(notices)), (501, ordinary * 50 + "x. " + notices[1] + " " + ordinary + notices[2])]
    got = {r.doc_id: r for r in scan_licenses(table(rows)).collect()}
    assert got[500]["labels"] == wanted
    assert got[501]["labels"] == ["cc-by-4.0", "reserved"]
    assert all(got[100 + i]["labels"] == ["reserved"] for i in range(12))
    assert all(got[i]["labels"] == [] for i in range(20))
    assert all(r.score <= 1 for r in got.values())
