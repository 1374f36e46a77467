"""Known sentences and rules in the wordings of their publishers."""

from orderflow.llm import licenses

GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version."
HOPE = "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
NOTICE = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
NAMES = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy"
OWNER = "MIT License\n\nCopyright (c) 2020 A. Person\n\n"

TEXTS = [
    (OWNER + GRANT + NOTICE + AS_IS, "MIT", "mit_grant mit_notice as_is"),
    ("Copyright (c) 2020 A. Person\n\n" + ISC, "ISC", "isc_grant"),
    ("Copyright (c) 2020, A\n\n" + BSD + NAMES, "BSD-3-Clause", "bsd_use bsd_source bsd_binary bsd_names"),
    ("/*\n" + "".join(f" * {x}\n" for x in BSD.split("\n")) + " */", "BSD-2-Clause", "bsd_use bsd_source bsd_binary"),
    (APACHE, "Apache-2.0", "apache_under apache_comply"),
    (APACHE.replace("2.0 (", "2.0\n("), "Apache-2.0", "apache_under apache_comply"),
    (GPL.format(":", ",", 3) + HOPE, "GPL-3.0-or-later", "gpl3_free gpl_hope"),
    (GPL.format(";", ";", 2) + HOPE, "GPL-2.0-or-later", "gpl2_free gpl_hope"),
    (GPL.format(":", ",", 3), "GPL-3.0-or-later", "gpl3_free"),
    (GPL.format(";", ";", 2), "GPL-2.0-or-later", "gpl2_free"),
    ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not", "MPL-2.0", "mpl_subject"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT", "spdx_mit"),
    ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0", "spdx_apache"),
    ("/* SPDX-License-Identifier: GPL-3.0-only */\n", "GPL-3.0-only", "spdx_gpl3"),
    ("SPDX-License-Identifier: GPL-3.0-or-later\r\nx", "GPL-3.0-or-later", "spdx_gpl3_later"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", "spdx_bsd3"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", "gpl3_work"),
    ("Licensed under the GNU General Public License version 3. x", "GPL-3.0-only", "gpl3_under"),
    ("This work is licensed under the GNU General\nPublic License version 2.", "GPL-2.0-only", "gpl2_work"),
    ("Released under the MIT License.", "MIT", "mit_released"),
    ("Licensed under the MIT License.", "MIT", "mit_under"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", "apache_short"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause", "bsd3_under"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0", "cc_by"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", "cc_by_sa"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "cc_by_nc"),
    # a line of its own beside a wrapped text
    ("abc\nReleased under the MIT License\nabc\n\n" + BSD + NAMES + "\nabc\nLicensed under CC BY 4.0\nabc", "BSD-3-Clause,MIT,CC-BY-4.0", "mit_released bsd_use bsd_source bsd_binary bsd_names cc_by"),
    ("All of it is licensed under the MIT license or not", "", ""),
]


def test_official_wordings(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.sentence_ids, r.n_leftover) for r in licenses.license_matches(docs).collect()}
    assert got == {i: (names, "".join(f"<{x}>" for x in ids.split()), 0) for i, (_, names, ids) in enumerate(TEXTS)}
    assert {x for _, _, ids in TEXTS for x in ids.split()} | {i for _, _, ids in FURTHER for i in ids.split()} == set(licenses.SENTENCES) | set(licenses.SPDX)


LESSER = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version.\n"
FURTHER = [
    ("Copyright (c) Acme\n\n" + BSD + NAMES.replace("the copyright holder", "Acme Corp."), "BSD-3-Clause", "bsd_use bsd_source bsd_binary bsd_names"),
    (BSD + "3. The name of the author(s) may not be used to endorse or promote products\n   derived from this software without specific prior written permission.", "BSD-3-Clause", "bsd_use bsd_source bsd_binary bsd_name"),
    (LESSER.format("2.1"), "LGPL-2.1-or-later", "lgpl21_free"),
    (LESSER.format("3"), "LGPL-3.0-or-later", "lgpl3_free"),
    (GPL.replace("GNU General", "GNU Affero General").format(":", ",", 3) + HOPE, "AGPL-3.0-or-later", "agpl3_free gpl_hope"),
    (GPL.replace("GNU General", "GNU Affero General").format(":", ",", 3), "AGPL-3.0-or-later", "agpl3_free"),
    ("                              Apache License\n                        Version 2.0, January 2004\n                     http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.", "Apache-2.0", "apache_terms"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "GPL-3.0-only", "gpl3_text"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n", "GPL-2.0-only", "gpl2_text"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "LGPL-3.0-only", "lgpl3_text"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n", "LGPL-2.1-only", "lgpl21_text"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n", "AGPL-3.0-only", "agpl3_text"),
    ("Mozilla Public License Version 2.0\n====\n", "MPL-2.0", "mpl_text"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free", "Unlicense", "unlicense"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available", "EPL-2.0", "epl_under"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\n\n", "EPL-2.0", "epl_under"),
    ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (\"AGREEMENT\"). ANY USE", "EPL-2.0", "epl_text"),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE", "CC0-1.0", "cc0_text"),
    ("To the extent possible under law, A. N. Other has waived all copyright and related or neighboring rights to\nthis work.", "CC0-1.0", "cc0_under"),
    ("This project is licensed under the MIT License - see the LICENSE file.", "MIT", "mit_project"),
    ("This project is licensed under the Apache License 2.0 (see LICENSE).", "Apache-2.0", "apache_project"),
    ("It is free, licensed under the MIT License, and small.", "MIT", "mit_under"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nx", "MIT,Apache-2.0", "spdx_mit spdx_apache"),
    ("SPDX-License-Identifier: (LGPL-2.1-only OR GPL-3.0-or-later) AND ISC", "GPL-3.0-or-later,LGPL-2.1-only,ISC", "spdx_lgpl21 spdx_gpl3_later spdx_isc"),
    *((f"# SPDX-License-Identifier: {name}\n", name, i) for i, name in licenses.SPDX.items()),
]


def test_further_wordings_and_their_sql(spark, tmp_path):
    every = TEXTS + FURTHER
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(every)], "doc_id long, text string")
    got = {r.doc_id: (set(r.licenses.split(",")), r.sentence_ids) for r in licenses.license_matches(docs).collect()}
    assert got == {i: (set(names.split(",")), "".join(f"<{x}>" for x in ids.split())) for i, (_, names, ids) in enumerate(every)}
    import duckdb

    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        wanted = {i: (names, ids) for i, ids, names, _, _ in con.execute(licenses.op2_oracle()).fetchall()}
    assert wanted == {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.license_matches(docs).collect()}
