"""Wrapped notices, whole licence files and SPDX tags."""

from pyspark.sql import functions as F

from barline.llm import licences


def test_wrapped_headers_files_and_tags(spark):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    gpl = "# This program is free software: you can\n# redistribute it and/or modify it under the\n# terms of the GNU General Public License as\n# published by the Free Software Foundation,\n# either version 3 of the License, or (at your\n# option) any later version."
    bsd = "Copyright (c) 2020, Some One\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer."
    mit = "MIT License\n\nCopyright (c) 2021 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
    prose = "the water of the river and the trees\nwent to the house with a copy of it\n"
    want = [
        (mpl, "MPL-2.0"), (prose * 3 + mpl + "\n" + prose * 3, "MPL-2.0"), (mpl.replace("\n", "\r\n"), "MPL-2.0"), (gpl, "GPL-3.0"), (bsd, "BSD-3-Clause"), (mit, "MIT"), (apache, "Apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("All rights reserved.", "Proprietary"), ("# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1", "GPL-3.0"), ("/* SPDX-License-Identifier: (LGPL-2.1 OR MPL-2.0) */", "MPL-2.0"),
        ("// SPDX-License-Identifier: LGPL-2.1-only", None), (prose, None), (prose + "they had no permission to go\n" + prose, None),
    ]
    want += [(f"SPDX-License-Identifier: {k}", k) for k in licences.TEMPLATES if k != "Proprietary"]
    docs = spark.createDataFrame([(i, t, f"d{i}/x") for i, (t, _) in enumerate(want)], "doc_id long, text string, at string")
    got = {r.doc_id: r.licence for r in licences.scan(docs, "at").collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(want)] == want


def test_passages_hold_the_neighbours_in_the_paragraph(spark):
    text = "a\nb\nc\nlicence\nd\ne\nf\n\ng\n# --\nh"
    (row,) = spark.createDataFrame([(text,)], "text string").select(licences.passages(F.col("text")).alias("p")).collect()
    assert row.p == ["licence", "a\nb\nc\nlicence\nd\ne\nf", "b\nc\nlicence\nd\ne"]
