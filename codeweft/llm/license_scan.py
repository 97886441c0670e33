"""License scans by ordered signature rules, in DataFrame operations only.

A rule is a license name, or a sentence of its text (a regex over words that begins with a keyword), in a template (a
regex over the words before it, which sets priority and confidence). NAMES holds two hundred of them; IDENTIFIERS are
further names that count after the templates of IDENTIFIED only, since they are common words elsewhere. Rules are gated twice: a text is looked at only if it contains
the words of an entry of GATE (each rule's match has those of one), and a name's regex runs only where its keyword stands, on the LEFT words
before and the RIGHT words from there. The regexes see lower-cased words joined by single spaces, so line breaks and punctuation don't matter.

A detection is an interval of words with its rule's priority (1 is best) and confidence. It is suppressed if it lies
inside the interval of a better priority, or inside a longer one of its own priority; the rest give the labels.
Base phrases (BASE) always keep their labels. No interval is longer than LEFT + RIGHT words, so a detection is compared
with its neighbours in sorted order only (_AROUND: as many as there can be).

All work is done within a row: no shuffle, and equal texts, repeated rows or ids need no care. Defined results: null or
empty text has no words, no labels ('' and '') and score 0; equal detections (of one interval, priority, label and
score) count once, and of two that hold each other at one priority both stay; a very long text is scanned whole; an
empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import RAW_ALNUM, alnum_words, free_name, table

LEFT, RIGHT = 8, 16
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_V = "(?: version| v)?"
_L = "(?: licen[cs]e)"
#: (label, keyword, regex of the words from the keyword on)
NAMES = (
    ("mit", "mit", f"mit{_L}"), ("mit", "expat", f"expat{_L}"), ("mit", "mit", f"mit (?:expat|x11|style){_L}?"), ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("x11", "x11", f"x11{_L}"), ("x11", "x", f"x consortium{_L}"),
    ("apache", "apache", f"apache(?: software)?{_L}{_V}(?: 1 0| 1 1| 2 0| 2)?"), ("apache", "apache", "apache (?:1 1|2 0|2)"), ("apache", "asl", f"asl{_V} 2(?: 0)?"),
    ("gpl", "gnu", f"gnu general public{_L}{_V}(?: [123])?(?: 0)?(?: or (?:any )?later)?"), ("gpl", "general", f"general public{_L}{_V}(?: [123])?(?: 0)?(?: or (?:any )?later)?"),
    ("gpl", "gnu", "gnu gpl(?:v[123])?"), ("gpl", "gpl", f"gpl{_V}(?: [123])?(?: 0)?(?: only| or later)?"), ("gpl", "gplv2", "gplv2"), ("gpl", "gplv3", "gplv3"),
    ("lgpl", "gnu", f"gnu (?:lesser|library) general public{_L}{_V}(?: [23])?"), ("lgpl", "lesser", f"lesser general public{_L}{_V}(?: [23])?"),
    ("lgpl", "library", f"library general public{_L}"), ("lgpl", "lgpl", f"lgpl{_V}(?: [23])?(?: [01])?"), ("lgpl", "lgplv3", "lgplv3"),
    ("agpl", "gnu", f"gnu affero general public{_L}{_V}(?: 3)?"), ("agpl", "affero", f"affero general public{_L}{_V}(?: 3)?"), ("agpl", "agpl", f"agpl{_V}(?: 3)?"), ("agpl", "agplv3", "agplv3"),
    ("gfdl", "gnu", f"gnu free documentation{_L}"), ("gfdl", "gfdl", "gfdl"),
    ("bsd", "bsd", f"bsd(?: [0234] clause)?{_L}"), ("bsd", "bsd", "bsd [234] clause"), ("bsd", "3", f"3 clause bsd{_L}?"), ("bsd", "2", f"2 clause bsd{_L}?"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms"), ("0bsd", "0bsd", "0bsd"), ("bsd", "berkeley", f"berkeley software distribution{_L}"),
    ("mpl", "mozilla", f"mozilla public{_L}{_V}(?: 1 [01]| 2 0)?"), ("mpl", "mpl", f"mpl{_V}(?: 1 1| 2 0| 2)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("cc0", "creative", "creative commons zero"), ("cc0", "cc", "cc (?:zero|0)"),
    ("cc-by", "cc", f"cc by{_V}(?: [1234] 0)?"), ("cc-by-sa", "cc", f"cc by sa{_V}(?: [1234] 0)?"), ("cc-by-nc", "cc", f"cc by nc{_V}(?: [1234] 0)?"), ("cc-by-nd", "cc", f"cc by nd{_V}(?: [1234] 0)?"),
    ("cc-by-nc-sa", "cc", f"cc by nc sa{_V}(?: [1234] 0)?"), ("cc-by-nc-nd", "cc", f"cc by nc nd{_V}(?: [1234] 0)?"),
    ("cc-by", "creative", f"creative commons attribution(?: [1234] 0)?(?: international)?{_L}?"), ("cc-by-sa", "creative", f"creative commons attribution share ?alike(?: [1234] 0)?{_L}?"),
    ("cc-by-nc", "creative", f"creative commons attribution non ?commercial(?: [1234] 0)?{_L}?"), ("cc-by-nd", "creative", f"creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?{_L}?"),
    ("cc", "creative", f"creative commons{_L}"),
    ("epl", "eclipse", f"eclipse public{_L}{_V}(?: [12] 0)?"), ("epl", "epl", f"epl{_V}(?: [12] 0)?"), ("edl", "eclipse", f"eclipse distribution{_L}"),
    ("eupl", "european", f"european union public{_L}"), ("eupl", "eupl", f"eupl{_V}(?: 1 [12])?"), ("cddl", "common", f"common development and distribution{_L}"), ("cddl", "cddl", f"cddl{_V}(?: 1 [01])?"),
    ("cpl", "common", f"common public{_L}"), ("cpal", "common", f"common public attribution{_L}"), ("isc", "isc", f"isc{_L}"), ("zlib", "zlib", f"zlib(?: libpng)?{_L}"), ("libpng", "libpng", f"libpng{_L}"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("boost", "boost", f"boost software{_L}{_V}(?: 1 0)?"), ("boost", "bsl", "bsl 1 0"),
    ("artistic", "artistic", f"artistic{_L}{_V}(?: [12] 0)?"), ("postgresql", "postgresql", f"postgresql{_L}"), ("psf", "python", f"python software foundation{_L}"), ("psf", "psf", f"psf{_L}"),
    ("ruby", "ruby", f"ruby{_L}"), ("php", "php", f"php{_L}"), ("openssl", "openssl", f"openssl{_L}"), ("ofl", "sil", f"sil open font{_L}"), ("ofl", "open", f"open font{_L}"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)?{_L}"), ("ms-pl", "microsoft", f"microsoft public{_L}"), ("ms-rl", "microsoft", f"microsoft reciprocal{_L}"), ("cecill", "cecill", f"cecill(?: [abc])?{_L}?"),
    ("afl", "academic", f"academic free{_L}"), ("osl", "open", f"open software{_L}"), ("upl", "universal", f"universal permissive{_L}"), ("ncsa", "ncsa", f"ncsa(?: open source)?{_L}"), ("curl", "curl", f"curl{_L}"),
    ("json", "json", f"json{_L}"), ("beerware", "beerware", f"beerware{_L}?"), ("odbl", "open", f"open (?:data|database)(?: commons)?(?: open database)?{_L}"), ("odbl", "odbl", "odbl"), ("pddl", "pddl", "pddl"),
    ("sspl", "server", f"server side public{_L}"), ("sspl", "sspl", "sspl"), ("busl", "business", f"business source{_L}"), ("elastic", "elastic", f"elastic{_L}{_V}(?: 2 0)?"),
    ("vim", "vim", f"vim{_L}"), ("lppl", "latex", f"latex project public{_L}"), ("lppl", "lppl", "lppl"), ("blueoak", "blue", f"blue oak model{_L}"), ("apsl", "apple", f"apple public source{_L}"),
    ("ipl", "ibm", f"ibm public{_L}"), ("qpl", "q", f"q public{_L}"), ("sleepycat", "sleepycat", f"sleepycat{_L}"), ("zpl", "zope", f"zope public{_L}"), ("intel", "intel", f"intel open source{_L}"),
    ("all-rights-reserved", "all", "all rights reserved"), ("proprietary", "proprietary", "proprietary and confidential"), ("proprietary", "proprietary", f"proprietary{_L}"),
    ("public-domain", "public", "public domain"), ("commercial", "commercial", f"commercial{_L}"),
    ("aladdin", "aladdin", f"aladdin free public{_L}"), ("apl", "adaptive", f"adaptive public{_L}"), ("aal", "attribution", f"attribution assurance{_L}"), ("bittorrent", "bittorrent", f"bittorrent open source{_L}"),
    ("bouncycastle", "bouncy", f"bouncy castle{_L}"), ("cnri", "cnri", f"cnri(?: python| jython)?(?: open source)?{_L}"), ("cua", "cua", f"cua office public{_L}"), ("condor", "condor", f"condor public{_L}"),
    ("ecl", "educational", f"educational community{_L}{_V}(?: [12] 0)?"), ("efl", "eiffel", f"eiffel forum{_L}{_V}(?: [12])?"), ("entessa", "entessa", f"entessa public{_L}"), ("eudatagrid", "eu", f"eu datagrid(?: software)?{_L}"),
    ("fair", "fair", f"fair{_L}"), ("frameworx", "frameworx", f"frameworx(?: open)?{_L}"), ("ftl", "freetype", f"freetype(?: project)?{_L}"), ("gl2ps", "gl2ps", f"gl2ps{_L}"), ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("icu", "icu", f"icu{_L}"), ("ijg", "independent", f"independent jpeg group(?: s)?{_L}"), ("imagemagick", "imagemagick", f"imagemagick{_L}"), ("info-zip", "info", f"info zip{_L}"), ("ipa", "ipa", f"ipa font{_L}"),
    ("jasper", "jasper", f"jasper{_L}"), ("libtiff", "libtiff", f"libtiff{_L}"), ("lpl", "lucent", f"lucent public{_L}"), ("miros", "miros", f"miros{_L}"), ("motosoto", "motosoto", f"motosoto(?: open source)?{_L}"),
    ("mulan-psl", "mulan", f"mulan permissive software{_L}{_V}(?: [12])?"), ("mulan-psl", "mulan", f"mulan psl{_V}(?: ?[12])?"), ("mulan-publ", "mulan", f"mulan public{_L}"), ("multics", "multics", f"multics{_L}"), ("nasa", "nasa", "nasa open source agreement"),
    ("naumen", "naumen", f"naumen public{_L}"), ("net-snmp", "net", f"net snmp{_L}"), ("netcdf", "netcdf", f"netcdf{_L}"), ("nokia", "nokia", f"nokia open source{_L}"), ("npl", "netscape", f"netscape public{_L}{_V}(?: 1 [01])?"),
    ("nposl", "non", f"non profit open software{_L}"), ("ntp", "ntp", f"ntp{_L}"), ("oclc", "oclc", f"oclc research public{_L}"), ("ogl", "open", f"open government{_L}{_V}(?: [123] 0)?"), ("ogtsl", "open", f"open group test suite{_L}"),
    ("oldap", "openldap", f"openldap public{_L}{_V}(?: 2 8)?"), ("opl", "open", f"open publication{_L}"), ("parity", "parity", f"parity public{_L}"), ("polyform", "polyform", f"polyform (?:noncommercial|small business|shield|strict|free trial){_L}"),
    ("rpl", "reciprocal", f"reciprocal public{_L}"), ("rpsl", "realnetworks", f"realnetworks public source{_L}"), ("rscpl", "ricoh", f"ricoh source code public{_L}"), ("sgi-b", "sgi", f"sgi free software{_L}(?: b)?"),
    ("simpl", "simple", f"simple public{_L}"), ("sissl", "sun", f"sun industry standards source{_L}"), ("spl", "sun", f"sun public{_L}"), ("smlnj", "standard", f"standard ml of new jersey{_L}"), ("tcl", "tcl", f"tcl(?: tk)?{_L}"),
    ("unicode", "unicode", f"unicode{_L}"), ("vsl", "vovida", f"vovida software{_L}"), ("watcom", "sybase", f"sybase open watcom public{_L}"), ("xerox", "xerox", f"xerox{_L}"), ("xfree86", "xfree86", f"xfree86{_L}"), ("xnet", "xnet", f"xnet{_L}"),
    ("ypl", "yahoo", f"yahoo public{_L}"), ("zend", "zend", f"zend(?: engine)?{_L}"), ("zimbra", "zimbra", f"zimbra public{_L}"), ("commons-clause", "commons", "commons clause"), ("hippocratic", "hippocratic", f"hippocratic{_L}"),
    ("anti-996", "anti", f"anti 996{_L}"), ("llama", "llama", f"llama(?: [234])?(?: [0-9])? community{_L}"), ("openrail", "openrail", "openrail(?: m)?"), ("free-art", "free", f"free art{_L}"), ("etalab", "etalab", f"etalab(?: open)?{_L}"),
    ("cern-ohl", "cern", f"cern open hardware{_L}"), ("solderpad", "solderpad", f"solderpad(?: hardware)?{_L}"), ("tapr-ohl", "tapr", f"tapr open hardware{_L}"), ("dfsl", "german", f"german free software{_L}"), ("gust", "gust", f"gust font{_L}"),
    ("bitstream", "bitstream", f"bitstream vera(?: fonts?)?{_L}"), ("ubuntu-font", "ubuntu", f"ubuntu font{_L}"), ("freebsd-doc", "freebsd", f"freebsd documentation{_L}"), ("ldp", "linux", f"linux documentation project{_L}"),
    ("dsl", "design", f"design science{_L}"), ("odc-by", "open", f"open data commons attribution{_L}"), ("cdla", "community", f"community data{_L} agreement"), ("o-uda", "open", "open use of data agreement"), ("c-uda", "computational", "computational use of data agreement"),
    ("nist", "nist", f"nist(?: software)?{_L}"), ("imatix", "imatix", f"imatix(?: standard function library)?{_L}"), ("erlang", "erlang", f"erlang public{_L}"), ("interbase", "interbase", f"interbase public{_L}"), ("idpl", "initial", f"initial developer(?: s)? public{_L}"),
    ("sugarcrm", "sugarcrm", f"sugarcrm public{_L}"), ("llvm-exception", "llvm", "llvm exceptions?"), ("classpath-exception", "classpath", "classpath exception"), ("gcc-exception", "gcc", "gcc runtime library exception"), ("perl", "same", "same terms as perl(?: itself)?"),
    # sentences of the licenses' own texts
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"), ("boost", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose"), ("gpl", "redistribute", "redistribute it and or modify it under the terms of the gnu general public"),
    ("lgpl", "redistribute", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public"), ("agpl", "redistribute", "redistribute it and or modify it under the terms of the gnu affero general public"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"), ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither", "neither the name of(?: [a-z0-9]+){1,6} nor the names of its contributors"), ("zlib", "altered", "altered source versions must be plainly marked as such"), ("zlib", "misrepresented", "misrepresented as being the original software"),
    ("unlicense", "unencumbered", "unencumbered software released into the public domain"), ("wtfpl", "do", "do what the fuck you want to"), ("cc0", "waived", "waived all copyright and related or neighboring rights"),
    ("apache", "unless", "unless required by applicable law or agreed to in writing software distributed under the"), ("mpl", "source", "source code form is subject to the terms of the mozilla public"),
    ("epl", "accompanying", "accompanying materials are made available under the terms of the eclipse public"), ("hpnd", "appear", "appear in supporting documentation"), ("x11", "except", "except as contained in this notice the name of"),
    ("openssl", "developed", "developed by the openssl project for use in the openssl toolkit"), ("ofl", "reserved", "reserved font name"), ("artistic", "standard", "standard version of the package"), ("public-domain", "dedicated", "dedicated to the public domain"),
    ("public-domain", "placed", "placed in(?:to)? the public domain"), ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: [a-z]+){0,6} prohibited"),
    ("all-rights-reserved", "no", "no part of this (?:publication|document|software|book) may be reproduced"), ("cc-by-sa", "attribution", "attribution share ?alike [1234] 0 international"), ("cc-by", "attribution", "attribution [1234] 0 international"),
)
#: (priority, confidence, regex that the words before the name end with)
TEMPLATES = (
    (1, 1.0, "spdx licen[cs]e identifier"),
    (2, 0.97, "(?:licen[cs]ed|released|distributed|published|provided|available|covered|dual licensed) (?:to you )?(?:under|by)(?: the)?(?: terms of)?(?: the| a)?"),
    (3, 0.9, "(?:subject to|terms of|conditions of|accordance with|compliance with|governed by)(?: the| a)?"),
    (3, 0.85, "(?:copy of|see|refer to|permitted by|under)(?: the| a)?"),
    (4, 0.7, ""),
)
#: As NAMES, in the templates of IDENTIFIED only.
IDENTIFIERS = tuple(
    (label, name.split(" ")[0], name + ("" if name == "mit" else "(?: [0-9]+[a-z]?){0,3}"))
    for label, name in (
        ("mit", "mit"), ("mit", "expat"), ("x11", "x11"), ("apache", "apache"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("zlib", "zlib acknowledgement"), ("libpng", "libpng"), ("boost", "bsl"), ("artistic", "artistic"),
        ("postgresql", "postgresql"), ("psf", "python"), ("psf", "psf"), ("ruby", "ruby"), ("php", "php"), ("openssl", "openssl"), ("ofl", "ofl"), ("w3c", "w3c"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("afl", "afl"), ("osl", "osl"),
        ("upl", "upl"), ("ncsa", "ncsa"), ("curl", "curl"), ("json", "json"), ("busl", "busl"), ("elastic", "elastic"), ("vim", "vim"), ("blueoak", "blueoak"), ("apsl", "apsl"), ("ipl", "ipl"), ("qpl", "qpl"), ("sleepycat", "sleepycat"),
        ("zpl", "zpl"), ("intel", "intel"), ("cpl", "cpl"), ("cpal", "cpal"), ("edl", "edl"),
    )
)
IDENTIFIED = (TEMPLATES[0], (2, 0.97, "(?:dual )?licen[cs]ed (?:to you )?under(?: the)?(?: terms of)?(?: the)?"))
KEYWORDS = tuple(sorted({k for _, k, _ in NAMES + IDENTIFIERS}))


def _needed(name: str) -> tuple[str, ...]:
    """Words that each match of a name's regex holds, whole or as the beginning of a word: that for license, which many
    share, or the three longest."""
    if _L in name.replace(_L + "?", ""):
        return ("licen",)
    rest = re.sub(r"\[[^]]*\]", " ", name.replace(_L + "?", " "))
    while (less := re.sub(r"\(\?:[^()]*\)(?:\?|\{\d,\d\})?|. ?\?", " ", rest)) != rest:
        rest = less
    return tuple(sorted(dict.fromkeys(re.findall("[a-z][a-z0-9]+|[0-9][a-z0-9]+", rest)), key=lambda w: (-len(w), w))[:3])


#: A text without all words of any of these can't match. IDENTIFIERS need none of their own: their templates hold the
#: word license or licensed.
GATE = tuple(sorted({("licen",), *(_needed(name) for _, _, name in NAMES)}))
#: Detections that may hold another begin within LEFT + RIGHT words before it, so their anchors stand within LEFT words
#: more; an anchor is one keyword, with as many detections as names of it times templates. That many neighbours do.
_AROUND = (2 * LEFT + RIGHT + 1) * max(Counter(k for _, k, _ in NAMES + IDENTIFIERS).values()) * len(TEMPLATES)


def _count(s: Column) -> Column:
    """Words in a string of words joined by single spaces."""
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


def _named(x: Column) -> Column:
    """The names that match at an anchor: label and the words matched."""
    out = None
    for keyword in KEYWORDS:
        found = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_extract(x["right"], f"^(?:{name})(?= |$)", 0).alias("m"), F.lit(bare).alias("bare")) for names, bare in ((NAMES, False), (IDENTIFIERS, True)) for label, k, name in names if k == keyword])
        out = F.when(x["w"] == keyword, found) if out is None else out.when(x["w"] == keyword, found)
    return F.filter(out, lambda y: y["m"] != "")


def _detections(words: Column) -> Column:
    """All rule matches of a text, sorted by start, longest first."""
    anchors = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(*KEYWORDS))
    begin = lambda x: F.greatest(x["i"] - LEFT, F.lit(0))
    around = F.transform(
        anchors,
        lambda x: F.struct(
            x["i"].alias("i"), x["w"].alias("w"), F.array_join(F.slice(words, begin(x) + 1, x["i"] - begin(x)), " ").alias("left"), F.array_join(F.slice(words, x["i"] + 1, F.lit(RIGHT)), " ").alias("right")
        ),
    )
    named = F.flatten(F.transform(around, lambda x: F.transform(_named(x), lambda y: F.struct(x["i"].alias("i"), x["left"].alias("left"), y["label"].alias("label"), _count(y["m"]).alias("n"), y["bare"].alias("bare")))))

    def rule(x: Column, priority: int, score: float, before: str) -> Column:
        m = F.regexp_extract(x["left"], f"(?:^| )({before})$", 1) if before else F.lit("")
        start = x["i"] - _count(m)
        end = x["i"] + x["n"]
        it = F.struct(start.alias("start"), (-end).alias("minus_end"), F.lit(priority).alias("priority"), x["label"].alias("label"), F.lit(score).alias("score"))
        return F.when(m != "", it) if before else it

    matched = F.flatten(F.transform(named, lambda x: F.when(x["bare"], F.array(*[rule(x, *t) for t in IDENTIFIED])).otherwise(F.array(*[rule(x, *t) for t in TEMPLATES]))))
    return F.array_sort(F.array_distinct(F.filter(matched, lambda d: d.isNotNull())))


def _unsuppressed(found: Column) -> Column:
    size = lambda d: -d["minus_end"] - d["start"]
    over = lambda e, d: (e["start"] <= d["start"]) & (e["minus_end"] <= d["minus_end"]) & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (size(e) > size(d))))
    # in sorted order, what holds a detection comes before it
    return F.filter(found, lambda d, i: ~F.exists(F.slice(found, F.greatest(i + 1 - _AROUND, F.lit(1)), F.least(i, F.lit(_AROUND))), lambda e: over(e, d)))


def _base(words: Column) -> Column:
    """Places of the base phrases: start and label. All end with the word license."""
    w = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    at = F.filter(F.transform(words, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda x: x["w"] == "license")
    out = F.flatten(
        F.transform(
            at,
            lambda x: F.array(
                *[
                    F.when(F.array_join(F.transform(F.sequence(F.lit(1 - n), F.lit(-1)), lambda j: w(x["i"] + j)), " ") == head, F.struct((x["i"] - (n - 1)).alias("start"), F.lit(label).alias("label")))
                    for phrase, label in BASE.items()
                    for head, n in [(phrase.rpartition(" ")[0], phrase.count(" ") + 1)]
                ]
            ),
        )
    )
    return F.filter(out, lambda d: d.isNotNull())


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `scan` (`scan_` beside one of that name): n_words, base (array of start, label), found (unsuppressed detections: start,
    end, priority, label, score)."""
    low = F.lower(F.col(text))
    gate = F.lit(False)
    for terms in GATE:
        gate = gate | reduce(and_, (low.contains(t) for t in terms))
    gate = F.coalesce(gate, F.lit(False))
    words, all_, base = (free_name(docs, c) for c in ("__words", "__all", "__base"))
    out = docs.withColumn(words, F.when(gate, alnum_words(F.col(text))))
    out = out.withColumn(all_, _detections(F.col(words))).withColumn(base, _base(F.col(words)))
    found = F.transform(
        _unsuppressed(F.col(all_)),
        lambda d: F.struct(d["start"].cast("long").alias("start"), (-d["minus_end"]).cast("long").alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score")),
    )
    none = F.coalesce(F.regexp_count(F.col(text), F.lit(RAW_ALNUM)), F.lit(0)).cast("long")
    return out.withColumn(free_name(docs, "scan"), F.struct(none.alias("n_words"), F.coalesce(base, F.expr("cast(array() as array<struct<start:int,label:string>>)")).alias("base"), found.alias("found"))).drop(words, all_, base)


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, found = F.col("scan.base"), F.coalesce(F.col("scan.found"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,priority:int,label:string,score:double>>)"))
    labels = lambda a: F.transform(a, lambda d: d["label"])
    start = F.transform(base, lambda d: d["start"].cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["score"])), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        joined(labels(base)).alias("base_labels"),
        joined(F.concat(labels(base), labels(found))).alias("labels"),
        score.alias("score"),
        F.size(found).cast("long").alias("n_found"),
    )


QUERIES = {"op9_license": op9_license}
#: The rules' labels are regexes over word windows with suppression, too slow in SQL; tested against brute force.
ORACLES: dict[str, str] = {}
