import random

import duckdb
SF = "/root/testdata/sf0.001"
#: Columns of ``documents`` and more, some of them named like what operators add.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, kept string, bands string, findings string, label int, rank int"


def read(sql):
    return duckdb.connect().execute(sql).fetchall()


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choice(vocabulary) for _ in range(n))
