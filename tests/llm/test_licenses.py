"""Headers, notices, identifier lines and heads of whole texts, as real files carry them."""

import pytest

from tallywind.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
CASES = {"SPDX-License-Identifier: Apache-2.0":["Apache-2.0"],"// SPDX-License-Identifier: MIT\nint x;":["MIT"],"/* SPDX-License-Identifier: GPL-2.0-or-later */":["GPL-2.0-or-later"],
"This project is licensed under the MIT License.":["MIT"],"This project is licensed under the MIT License - see the LICENSE file":[],"Licensed under the MIT License.":["MIT"],"Released under the MIT License.":["MIT"],"This file is licensed under the terms of the Apache License, Version 2.0.":["Apache-2.0"],
"# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.":["Apache-2.0"],
BSD:["BSD-2-Clause"],BSD + "3. Neither the name of the University of Foo nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n":["BSD-3-Clause"],
BSD + "3. Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.":["BSD-3-Clause"],
BSD + "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n":["BSD-3-Clause"],
"                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n":["Apache-2.0"],
"                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n":["GPL-3.0-only"],"GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999":["LGPL-2.1-only"],
"This is free and unencumbered software released into the public domain.\n":["Unlicense"],"Boost Software License - Version 1.0 - August 17th, 2003\n":["BSL-1.0"],"Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------":["MPL-2.0"],
"Eclipse Public License - v 2.0\n":["EPL-2.0"],"Distributed under the Boost Software License, Version 1.0.":["BSL-1.0"],"This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.":["CC-BY-SA-4.0"],"Licensed under CC BY 4.0.":["CC-BY-4.0"],"MIT":[]}


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    return {list(CASES)[r.doc_id]: r for r in licenses.scan(df.union(df)).collect()}


@pytest.mark.parametrize("text", CASES)
def test_license(scanned, text):
    assert scanned[text].licenses == CASES[text]
    assert scanned[text].copies == 2


def test_no_sentence_has_two_identifiers():
    known = [licenses._canonical(licenses._plain(t)) for t in licenses.SENTENCES.values()]
    assert len(known) == len(set(known))
