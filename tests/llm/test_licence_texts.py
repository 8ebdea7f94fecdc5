"""Licence texts as they come: wrapped at 70 to 80 columns, in comments, by SPDX line, and notices with any subject."""

import textwrap


from armwave.llm import licences

MIT = ["MIT License", "Copyright (c) 2020 Jane Doe", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]
BSD = ["Copyright (c) 2020, Jane Doe", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
ISC = ["ISC License", "Copyright (c) 2020 Jane Doe", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
GPL = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
       "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."]
TEXTS = {"MIT": MIT, "BSD-2-Clause": BSD, "ISC": ISC, "GPL-3.0-or-later": GPL}
LINES = {"SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
         "This software is released under the MIT license.": "MIT", "Foo is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1-only",
         "This file is distributed under the terms of the GNU Affero General Public License v3.": "AGPL-3.0-only"}


def wrapped(parts, width, mark=""):
    gap = f"\n{mark.rstrip()}\n"
    return gap.join("\n".join(mark + line for line in textwrap.wrap(p, width)) for p in parts)


def test_wrapped_and_line_notices(spark):
    rows = [(wrapped(parts, width, mark), name) for name, parts in TEXTS.items() for width in (70, 78) for mark in ("", "# ", " * ", "// ")]
    rows += list(LINES.items()) + [("int x;\n" + k + "\nint y;", v) for k, v in LINES.items()]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    wrong = [(t, got[i], name) for i, (t, name) in enumerate(rows) if got[i] != [name]]
    assert wrong == []


def test_line_notices_with_open_subjects(spark):
    cases = [("This article is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]), ("The figures are licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
             ("All maps are released under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
             ("This plugin is available under the terms of the Eclipse Public License 2.0.", ["EPL-2.0"]), ("It is distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
             ("The garden is open under a blue sky.", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(df).collect()} == {i: x for i, (_, x) in enumerate(cases)}
