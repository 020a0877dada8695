"""Licence texts over several lines, and several licences in one."""

from lectern.llm import licences
from lectern.llm.queries import table

MIT = """The MIT License (MIT)

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are met:
//
// 1. Redistributions of source code must retain the above copyright notice."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


def test_wrapped_licences(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    both = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    rows = [(10_000, MIT), (10_001, BSD), (10_002, GPL), (10_003, both), (10_004, "Licensed under CC BY-NC 4.0."), (10_005, "one\n\ntwo words\nand three")]
    got = {r["doc_id"]: r for r in licences.scan_licences(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 10000").collect()}
    assert [got[10_000 + i]["families"] for i in range(6)] == [["mit"], ["bsd"], ["gpl"], ["apache", "mit"], ["cc-by-nc"], []]
    assert 4 in [f["line"] for f in got[10_000]["found"]] and got[10_001]["found"][0]["line"] == 0
