"""License scans: known licence sentences, then ordered rules over the identifiers that a document shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of licence notices, normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    "apache2_notice": "licensed under the apache license version 2 0",
    "apache2_notice_the": "licensed under the apache license version 2 0 the license",
    "apache2_compliance": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_release": "released under the mit license",
    "mit_notice": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_notice_kept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl2_work": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

# Licences by identifier, with the names that notices call them by (normalised).
NAMES = {
    "0BSD": ("bsd zero clause license", "zero clause bsd license"),
    "AFL-3.0": ("academic free license version 3 0", "academic free license 3 0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "agpl 3 0", "agplv3"),
    "APSL-2.0": ("apple public source license version 2 0", "apple public source license 2 0"),
    "Apache-1.1": ("apache software license version 1 1",),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "Artistic-1.0": ("artistic license 1 0",),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "2 clause bsd license", "freebsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license"),
    "BSD-4-Clause": ("bsd 4 clause license", "original bsd license", "4 clause bsd license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "BlueOak-1.0.0": ("blue oak model license 1 0 0",),
    "CC-BY-3.0": ("creative commons attribution 3 0 unported license", "cc by 3 0"),
    "CC-BY-4.0": ("creative commons attribution 4 0 international license",),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license",),
    "CC-BY-NC-ND-4.0": ("creative commons attribution noncommercial noderivatives 4 0 international license", "cc by nc nd 4 0"),
    "CC-BY-NC-SA-4.0": ("creative commons attribution noncommercial sharealike 4 0 international license", "cc by nc sa 4 0"),
    "CC-BY-ND-4.0": ("creative commons attribution noderivatives 4 0 international license", "cc by nd 4 0"),
    "CC-BY-SA-3.0": ("creative commons attribution sharealike 3 0 unported license", "cc by sa 3 0"),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license",),
    "CC0-1.0": ("cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "common development and distribution license 1 0"),
    "CDDL-1.1": ("common development and distribution license version 1 1",),
    "CECILL-2.1": ("cecill free software license agreement version 2 1", "cecill 2 1 license"),
    "CPL-1.0": ("common public license version 1 0", "common public license 1 0"),
    "ECL-2.0": ("educational community license version 2 0",),
    "EPL-1.0": ("eclipse public license v1 0", "eclipse public license 1 0", "eclipse public license version 1 0"),
    "EPL-2.0": ("eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license version 2 0"),
    "EUPL-1.1": ("european union public licence 1 1", "eupl version 1 1"),
    "EUPL-1.2": ("european union public licence 1 2", "eupl version 1 2", "eupl"),
    "GFDL-1.3": ("gnu free documentation license version 1 3",),
    "GPL-1.0": ("gnu general public license version 1",),
    "GPL-2.0": ("gnu general public license v2 0", "gpl 2 0", "gplv2", "gnu gpl version 2"),
    "GPL-3.0": ("gnu general public license v3 0", "gpl 3 0", "gplv3", "gnu gpl version 3"),
    "HPND": ("historical permission notice and disclaimer",),
    "IPL-1.0": ("ibm public license version 1 0",),
    "ISC": ("isc license",),
    "LGPL-2.0": ("gnu library general public license version 2",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"),
    "LPPL-1.3c": ("latex project public license version 1 3c",),
    "MIT": ("mit license", "expat license"),
    "MIT-0": ("mit no attribution license", "mit 0 license"),
    "MPL-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "MS-PL": ("microsoft public license", "microsoft public license ms pl"),
    "MS-RL": ("microsoft reciprocal license", "microsoft reciprocal license ms rl"),
    "MulanPSL-2.0": ("mulan permissive software license version 2", "mulan psl v2"),
    "NCSA": ("university of illinois ncsa open source license",),
    "ODbL-1.0": ("open database license", "open data commons open database license v1 0"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "OSL-3.0": ("open software license version 3 0", "open software license 3 0"),
    "PHP-3.01": ("php license version 3 01", "php license v3 01"),
    "PostgreSQL": ("postgresql license",),
    "Python-2.0": ("python software foundation license version 2", "psf license"),
    "QPL-1.0": ("q public license version 1 0",),
    "Ruby": ("ruby license",),
    "UPL-1.0": ("universal permissive license v 1 0", "universal permissive license version 1 0"),
    "Unlicense": ("unlicense",),
    "Vim": ("vim license",),
    "W3C": ("w3c software notice and license",),
    "WTFPL": ("do what the fuck you want to public license",),
    "ZPL-2.1": ("zope public license version 2 1", "zope public license zpl version 2 1"),
    "Zlib": ("zlib license", "zlib libpng license"),
}
# How a notice says that it is under a licence of that name (normalised); an identifier stands in a line of its own.
SAYING = (
    "^(?:(?:this|the) (?:work|file|code|source code|software|program|project|package|library|repository|module|data|dataset) is )?"
    "(?:licensed|released|distributed|available|made available|published|provided)(?: to you)?"
    " under (?:the terms of )?(?:(?:the|a|an) )?(.+?)(?: or at your option any later version| (?:please )?see .+| as (?:found|described|given) in .+| the license)?$"
)
LABEL = "^(?:software )?licen[cs]e (?:is )?(?:the )?(.+)$"
TAG = "spdx license identifier "
#: The third clause of a BSD licence, whoever is named in it.
ENDORSE = (
    "^(?:neither the names? .+ may be used|the names? of .+ may not be used) to endorse or promote products derived from th(?:is|e) software"
    " without (?:specific )?prior written permission(?: from .+)?$"
)


def _plain(licence: str) -> str:
    return licence.lower().replace("-", " ").replace(".", " ")


def _named() -> str:
    """The identifier of a sentence ``x`` that names a licence (name:MIT, tag:MIT; several of an expression, comma-joined), as
    SQL; only such sentences are looked at closely."""
    tags = {f"{_plain(x)}{more}": x for x in NAMES for more in ("", *((" only", " or later") if "GPL" in x or "GFDL" in x else ()))}
    names = {n: x for x, ns in NAMES.items() for n in ns}
    table = lambda entries: "map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in entries.items()) + ")"
    both = table(tags | names)
    # "A OR B", "A AND B", "A WITH an exception"; brackets are gone with all other marks
    parts = f"transform(split(substr(x, {len(TAG) + 1}), ' (?:or(?! later)|and) '), y -> try_element_at({table(tags)}, regexp_replace(y, ' with .*$', '')))"
    tagged = f"nullif(array_join(transform(filter({parts}, y -> y IS NOT NULL), y -> concat('tag:', y)), ','), '')"
    return (
        f"CASE WHEN startswith(x, '{TAG}') THEN {tagged} "
        f"WHEN contains(x, ' under ') THEN concat('name:', try_element_at({both}, regexp_extract(x, '{SAYING}', 1))) "
        f"WHEN length(x) < 80 AND x RLIKE '^(?:software )?licen[cs]e ' THEN concat('name:', try_element_at({both}, regexp_extract(x, '{LABEL}', 1))) "
        f"WHEN contains(x, ' to endorse or promote ') AND x RLIKE '{ENDORSE}' THEN 'bsd_endorse' END"
    )


#: Licence rules: the sentence identifiers that must occur in this order, with any sentences between them.
RULES = (
    ("Apache-2.0", ("apache2_notice",)),
    ("Apache-2.0", ("apache2_notice_the", "apache2_compliance", "apache2_copy")),
    ("MIT", ("mit_release",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_grant", "mit_notice_kept")),
    ("GPL-3.0", ("gpl3_work",)),
    ("GPL-3.0", ("gpl_free", "gpl_hope")),
    ("GPL-2.0", ("gpl2_work",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)),
    ("CC-BY-4.0", ("cc_by4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2",)),
)
#: A licence isn't reported where a longer rule that holds its sentences is met.
INSTEAD = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "MIT-0": ("MIT",)}

#: Whole sentences of standard texts that SENTENCES has in part, by the same identifiers, and others that they hold.
WHOLE = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0_grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_hope",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2_header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_free",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_free",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_free",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl_hope",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_disclaimer",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advertising",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this is free and unencumbered software released into the public domain": "unlicense_public",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_free",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_terms",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1_terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1_terms",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl_copy",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0",
    "to the extent possible under law the author s have waived all copyright and related or neighboring rights to this work": "cc0",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1": "bsd_grant",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2_copy",
    "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2_header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2_only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "gpl2_only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3_only",
    "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license": "mpl11_header",
    "this font software is licensed under the sil open font license version 1 1": "ofl_font",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql_grant",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl_terms",
}
WHOLE_RULES = (
    ("Apache-2.0", ("apache2_header", "apache2_copy")),
    ("GPL-2.0", ("gpl2_free", "gpl_hope")),
    ("GPL-2.0", ("gpl2_only",)),
    ("GPL-3.0", ("gpl3_only",)),
    ("AGPL-3.0", ("agpl3_free", "gpl_hope")),
    ("LGPL-2.1", ("lgpl21_free", "lgpl_hope")),
    ("LGPL-3.0", ("lgpl3_free", "lgpl_hope")),
    ("MIT-0", ("mit0_grant", "as_is")),
    ("ISC", ("isc_grant", "isc_disclaimer")),
    ("0BSD", ("bsd0_grant", "isc_disclaimer")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising")),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Unlicense", ("unlicense_public",)),
    ("BSL-1.0", ("boost_grant",)),
    ("EPL-2.0", ("epl2_terms",)),
    ("EPL-1.0", ("epl1_terms",)),
    ("WTFPL", ("wtfpl_copy",)),
    ("MPL-1.1", ("mpl11_header",)),
    ("OFL-1.1", ("ofl_font",)),
    ("PostgreSQL", ("postgresql_grant",)),
    ("CDDL-1.0", ("cddl_terms",)),
)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def scan_licenses(docs: DataFrame, sentences=None, rules=None) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, licenses for every row of ``docs``.

    Pieces end at a line's end or at a full stop, exclamation or question mark before a blank; ``n_sentences`` counts
    them. A sentence is the pieces up to such a mark, a colon at a line's end or a line without letters and digits (so a
    comment's empty line too), whatever lines it is wrapped over. It is normalised, without an item's number, and looked
    up; where it isn't known, its pieces are. ``sentence_ids`` are the known ones in order of occurrence, ``licenses``
    the names whose rule's identifiers occur in order, both comma-joined (empty if none). Null and empty texts have no
    sentences; repeated rows get a row each. Built-in expressions only, no shuffle.
    """
    known = {v: k for k, v in (sentences or SENTENCES).items()} | ({} if sentences else WHOLE)
    rules = RULES + WHOLE_RULES if rules is None else rules
    table = "map(" + ", ".join(f"{_text(v)}, {_text(k)}" for v, k in known.items()) + ")"
    lengths = ", ".join(str(n) for n in sorted({len(v) for v in known}))
    # sentences end at \u0001, which is taken out of the text before; "v. 2.0" and "Inc. nor" go on
    low = r"translate(lower(coalesce(text, '')), '\u0001', '-')"
    ends = rf"regexp_replace({low}, '(?<! v| inc| ltd| llc| corp| co)[.!?](?:[ \t\r]*\n|[ \t\r]+)|:[ \t\r]*(?=\n)|\n[^a-z0-9\n]*+(?=\n)', '$0\u0001')"
    pieces = r"split(regexp_replace(s, '([.!?])[ \t\r]+', '$1\n'), '\n', -1)"
    plain = "trim(regexp_replace({}, '[^a-z0-9]+', ' '))"
    # only a sentence as long as a known one is looked up
    find = f"IF(length(x) IN ({lengths}), try_element_at({table}, x), CAST(NULL AS STRING))"
    if not sentences:
        find = f"coalesce({find}, {_named()})"
    ids = f"filter(transform(p, x -> {find}), y -> y IS NOT NULL)"
    whole = f"transform(array(regexp_replace({plain.format('s')}, '^[0-9]{{1,2}} ', '')), x -> {find})[0]"
    one = f"transform(array(filter(transform({pieces}, q -> {plain.format('q')}), x -> x != '')), p -> struct(CAST(size(p) AS BIGINT) AS n, IF(size(p) > 1 AND w IS NOT NULL, array(w), {ids}) AS ids))[0]"
    body = f"transform(split({ends}, '\u0001', -1), s -> transform(array({whole}), w -> {one})[0])"
    parts = docs.select("doc_id", F.explode(F.array(F.expr(body))).alias("_p"))
    found = parts.select("doc_id", F.expr("struct(aggregate(_p.n, CAST(0 AS BIGINT), (a, b) -> a + b) AS n, flatten(transform(flatten(_p.ids), y -> split(y, ','))) AS ids)").alias("_f"))
    chain = F.concat(F.lit(","), F.array_join("_f.ids", ","), F.lit(","))
    # rules of one sentence are looked up by their sentence, longer ones matched against the sequence
    one = {w[0]: name for name, w in rules if len(w) == 1} | ({} if sentences else {f"{kind}:{x}": x for x in NAMES for kind in ("name", "tag")})
    single = F.expr(f"array_compact(transform(_f.ids, x -> try_element_at(map({', '.join(f'{_text(k)}, {_text(v)}' for k, v in one.items())}), x)))") if one else F.array().cast("array<string>")
    longer = [F.when(chain.rlike("," + ",(?:[^,]+,)*".join(w) + ","), F.lit(name)) for name, w in rules if len(w) > 1]
    held = F.array_distinct(F.concat(single, F.array_compact(F.array(*longer)))) if longer else F.array_distinct(single)
    hidden = [F.when(F.arrays_overlap("_h", F.array(*map(F.lit, more))), F.lit(name)) for name, more in INSTEAD.items()]
    found = found.withColumn("_h", F.when(F.size("_f.ids") > 0, held).otherwise(F.array().cast("array<string>")))
    licenses = F.array_join(F.array_sort(F.array_except("_h", F.array_compact(F.array(*hidden)))), ",")
    return found.select("doc_id", F.col("_f.n").alias("n_sentences"), F.size("_f.ids").cast("long").alias("n_known"), F.array_join("_f.ids", ",").alias("sentence_ids"), licenses.alias("licenses"))
