"""Signature rules of licences, by hand, in the order in which they are tried.

A line is: licence ~ kind ~ keywords ~ expression. Keywords gate the
expression: alternatives are parted by commas, and all words joined by + must
occur in the text in lower case. A space in an expression stands for white
space of any kind and length, and letters match in either case. The kind gives
the priority. Lines that begin with # are remarks.
"""

PRIORITIES = {"tag": 100, "text": 90, "notice": 80, "url": 70, "name": 60, "mention": 40, "weak": 20}

RULES = r"""
# the GNU family
AGPL-3.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?AGPL-3\.0(?:-only|-or-later|\+)?
GPL-3.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?GPL-3\.0(?:-only|-or-later|\+)?
GPL-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?GPL-2\.0(?:-only|-or-later|\+)?
GPL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?GPL-1\.0(?:-only|-or-later|\+)?
LGPL-3.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?LGPL-3\.0(?:-only|-or-later|\+)?
LGPL-2.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?LGPL-2\.1(?:-only|-or-later|\+)?
LGPL-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?LGPL-2\.0(?:-only|-or-later|\+)?
GFDL-1.3 ~ tag ~ spdx ~ SPDX-License-Identifier: ?GFDL-1\.3(?:-[a-z-]+)?
AGPL-3.0 ~ notice ~ affero ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?GNU Affero General Public Licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?(?: or (?:any )?later(?: version)?)?
GPL-3.0 ~ notice ~ gnu+licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?GNU General Public Licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?(?: or (?:any )?later(?: version)?)?
GPL-2.0 ~ notice ~ gnu+licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?GNU General Public Licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?(?: or (?:any )?later(?: version)?)?
LGPL-3.0 ~ notice ~ lesser+licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?GNU Lesser General Public Licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?(?: or (?:any )?later(?: version)?)?
LGPL-2.1 ~ notice ~ lesser+licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?GNU Lesser General Public Licen[sc]e,? (?:version|v\.?) ?2\.1(?: or (?:any )?later(?: version)?)?
LGPL-2.0 ~ notice ~ gnu+licen ~ (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?GNU Library General Public Licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?
GPL-any ~ notice ~ gnu+licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?GNU General Public Licen[sc]e
AGPL-3.0 ~ notice ~ redistribut+affero ~ redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3
GPL-3.0 ~ notice ~ redistribut+gnu ~ redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[,;:] (?:either )?version 3
GPL-2.0 ~ notice ~ redistribut+gnu ~ redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[,;:] (?:either )?version 2
GPL-1.0 ~ notice ~ redistribut+gnu ~ redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[,;:] (?:either )?version 1
LGPL-3.0 ~ notice ~ redistribut+lesser ~ redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[,;:] (?:either )?version 3
LGPL-2.1 ~ notice ~ redistribut+lesser ~ redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[,;:] (?:either )?version 2\.1
LGPL-2.0 ~ notice ~ redistribut+gnu ~ redistribute it and/or modify it under the terms of the GNU Library General Public License
GPL-3.0 ~ text ~ gnu+licen ~ GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
GPL-2.0 ~ text ~ gnu+licen ~ GNU GENERAL PUBLIC LICENSE Version 2, June 1991
GPL-1.0 ~ text ~ gnu+licen ~ GNU GENERAL PUBLIC LICENSE Version 1, February 1989
LGPL-3.0 ~ text ~ lesser+licen ~ GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
LGPL-2.1 ~ text ~ lesser+licen ~ GNU LESSER GENERAL PUBLIC LICENSE Version 2\.1, February 1999
LGPL-2.0 ~ text ~ gnu+licen ~ GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991
AGPL-3.0 ~ text ~ affero ~ GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
GFDL-1.3 ~ text ~ gnu+document ~ GNU Free Documentation License,? Version 1\.3
GFDL-1.2 ~ text ~ gnu+document ~ GNU Free Documentation License,? Version 1\.2
GFDL-1.1 ~ text ~ gnu+document ~ GNU Free Documentation License,? Version 1\.1
GPL-3.0 ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.\w+)?
GPL-2.0 ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.\w+)?
LGPL-3.0 ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.\w+)?
LGPL-2.1 ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.\w+)?
AGPL-3.0 ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.\w+)?
GFDL-any ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/(?:copyleft|licenses)/fdl(?:-1\.\d)?(?:\.\w+)?
GPL-any ~ url ~ gnu.org ~ https?://(?:www\.)?gnu\.org/licenses/(?:gpl\.\w+)?
AGPL-3.0 ~ name ~ affero ~ GNU Affero General Public Licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?
GPL-3.0 ~ name ~ gnu+licen ~ GNU General Public Licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?
GPL-2.0 ~ name ~ gnu+licen ~ GNU General Public Licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?
LGPL-3.0 ~ name ~ lesser+licen ~ GNU Lesser General Public Licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?
LGPL-2.1 ~ name ~ lesser+licen ~ GNU Lesser General Public Licen[sc]e,? (?:version|v\.?) ?2\.1
AGPL-3.0 ~ name ~ agpl ~ \bAGPL[- ]?(?:v|version )?3(?:\.0)?(?:\+|-only|-or-later)?\b
GPL-3.0 ~ name ~ gpl ~ (?<![AL])\bGPL[- ]?(?:v|version )?3(?:\.0)?(?:\+|-only|-or-later)?\b
GPL-2.0 ~ name ~ gpl ~ (?<![AL])\bGPL[- ]?(?:v|version )?2(?:\.0)?(?:\+|-only|-or-later)?\b
LGPL-3.0 ~ name ~ lgpl ~ \bLGPL[- ]?(?:v|version )?3(?:\.0)?(?:\+|-only|-or-later)?\b
LGPL-2.1 ~ name ~ lgpl ~ \bLGPL[- ]?(?:v|version )?2\.1(?:\+|-only|-or-later)?\b
GPL-3.0-with-GCC-exception ~ name ~ exception ~ GCC Runtime Library Exception(?:,? version 3\.1)?
GPL-2.0-with-classpath-exception ~ name ~ classpath ~ (?:GNU )?Classpath Exception
AGPL-any ~ mention ~ affero ~ (?:GNU )?Affero General Public Licen[sc]e
LGPL-any ~ mention ~ lesser+licen ~ (?:GNU )?Lesser General Public Licen[sc]e
GPL-any ~ mention ~ gnu+licen ~ GNU (?:General )?Public Licen[sc]e
GFDL-any ~ mention ~ document+licen ~ (?:GNU )?Free Documentation Licen[sc]e
AGPL-any ~ mention ~ agpl ~ \bAGPL\b
LGPL-any ~ mention ~ lgpl ~ \bLGPL\b
GPL-any ~ mention ~ gpl ~ \bGPL\b
# Apache
Apache-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?Apache-2\.0
Apache-1.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?Apache-1\.1
Apache-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?Apache-1\.0
Apache-2.0 ~ text ~ apache ~ Apache License Version 2\.0, January 2004
Apache-1.1 ~ text ~ apache ~ The Apache Software License, Version 1\.1
Apache-2.0 ~ notice ~ apache ~ licensed to the Apache Software Foundation \(ASF\) under one or more contributor license agreements
Apache-2.0 ~ notice ~ apache ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?Apache (?:Software )?Licen[sc]e,? (?:version|v\.?)? ?2(?:\.0)?
Apache-1.1 ~ notice ~ apache ~ (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?Apache (?:Software )?Licen[sc]e,? (?:version|v\.?)? ?1\.1
Apache-2.0 ~ url ~ apache.org ~ https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.\w+)?
Apache-1.1 ~ url ~ apache.org ~ https?://(?:www\.)?apache\.org/licenses/LICENSE-1\.1(?:\.\w+)?
Apache-2.0 ~ name ~ apache ~ Apache (?:Software )?Licen[sc]e,? (?:version|v\.?)? ?2(?:\.0)?
Apache-2.0 ~ name ~ apache ~ \bApache[- ]2(?:\.0)?\b
Apache-1.1 ~ name ~ apache ~ Apache (?:Software )?Licen[sc]e,? (?:version|v\.?)? ?1\.1
Apache-1.0 ~ name ~ apache ~ Apache (?:Software )?Licen[sc]e,? (?:version|v\.?)? ?1\.0
Apache-any ~ mention ~ apache ~ Apache (?:Software |Public )?Licen[sc]e
# MIT and its kin
MIT ~ tag ~ spdx ~ SPDX-License-Identifier: ?MIT(?![-\w])
MIT-0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?MIT-0
X11 ~ tag ~ spdx ~ SPDX-License-Identifier: ?X11
ISC ~ tag ~ spdx ~ SPDX-License-Identifier: ?ISC
Zlib ~ tag ~ spdx ~ SPDX-License-Identifier: ?Zlib
BSL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?BSL-1\.0
Unlicense ~ tag ~ spdx ~ SPDX-License-Identifier: ?Unlicense
WTFPL ~ tag ~ spdx ~ SPDX-License-Identifier: ?WTFPL
0BSD ~ tag ~ spdx ~ SPDX-License-Identifier: ?0BSD
MIT ~ text ~ permission ~ Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the ["“”]?Software["“”]?\), to deal in the Software without restriction
MIT ~ text ~ permission ~ The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
MIT-0 ~ text ~ attribution ~ MIT No Attribution
X11 ~ text ~ consortium ~ Except as contained in this notice, the name of the X Consortium shall not be used in advertising
ISC ~ text ~ permission ~ Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
0BSD ~ text ~ permission ~ Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.
NTP ~ text ~ permission ~ Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted
Zlib ~ text ~ warrant ~ This software is provided ['‘’"]as-is['‘’"],? without any express or implied warranty\. In no event will the authors be held liable
Zlib ~ text ~ altered ~ Altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software
BSL-1.0 ~ text ~ boost ~ Boost Software License - Version 1\.0 - August 17th,? 2003
Unlicense ~ text ~ unencumbered ~ This is free and unencumbered software released into the public domain
WTFPL ~ text ~ public ~ DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Beerware ~ text ~ beer ~ THE BEER-WARE LICENSE
MIT ~ notice ~ licen ~ (?:licensed|released|distributed|available|published|issued|provided) under (?:the )?(?:terms of )?(?:the )?(?:MIT|Expat)(?:/X11)? Licen[sc]e
ISC ~ notice ~ licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?ISC Licen[sc]e
Zlib ~ notice ~ zlib ~ (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?:/libpng)? Licen[sc]e
BSL-1.0 ~ notice ~ boost ~ Distributed under the Boost Software License, Version 1\.0
MIT ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.\w+)?
ISC ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/isc(?:-license)?(?:\.\w+)?
Zlib ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/zlib(?:-license)?(?:\.\w+)?
BSL-1.0 ~ url ~ boost.org ~ https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
Unlicense ~ url ~ unlicense.org ~ https?://(?:www\.)?unlicense\.org/?
WTFPL ~ url ~ wtfpl ~ https?://(?:www\.|sam\.zoy\.org/)?wtfpl(?:\.net)?/?
MIT ~ name ~ licen ~ \b(?:MIT|Expat)(?:/X11)? Licen[sc]e\b
MIT ~ name ~ licen ~ \bLicen[sc]e: ?MIT\b
X11 ~ name ~ licen ~ \bX11 Licen[sc]e\b
ISC ~ name ~ licen ~ \bISC Licen[sc]e\b
Zlib ~ name ~ zlib+licen ~ \bzlib(?:/libpng)? Licen[sc]e\b
BSL-1.0 ~ name ~ boost+licen ~ Boost Software Licen[sc]e(?:,? (?:version|v\.?) ?1\.0)?
Unlicense ~ name ~ unlicense ~ \bThe Unlicense\b
WTFPL ~ mention ~ wtfpl ~ \bWTFPL\b
Beerware ~ mention ~ beer+licen ~ \bbeer-?ware licen[sc]e\b
# BSD
BSD-3-Clause ~ tag ~ spdx ~ SPDX-License-Identifier: ?BSD-3-Clause(?![-\w])
BSD-2-Clause ~ tag ~ spdx ~ SPDX-License-Identifier: ?BSD-2-Clause(?![-\w])
BSD-4-Clause ~ tag ~ spdx ~ SPDX-License-Identifier: ?BSD-4-Clause(?![-\w])
BSD-3-Clause-Clear ~ tag ~ spdx ~ SPDX-License-Identifier: ?BSD-3-Clause-Clear
BSD-2-Clause-Patent ~ tag ~ spdx ~ SPDX-License-Identifier: ?BSD-2-Clause-Patent
BSD-4-Clause ~ text ~ advertis ~ All advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause ~ text ~ endorse ~ Neither the name of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
BSD-3-Clause ~ text ~ endorse ~ The names? of .{1,120}? may not be used to endorse or promote products derived from this software
BSD-2-Clause ~ text ~ redistribut ~ Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
BSD-any ~ text ~ redistribut ~ Redistribution and use in source and binary forms, with or without modification, are permitted
BSD-3-Clause ~ notice ~ licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?(?:3-clause|three-clause|new|modified|revised) BSD Licen[sc]e
BSD-2-Clause ~ notice ~ licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:the )?(?:2-clause|two-clause|simplified|FreeBSD) (?:BSD )?Licen[sc]e
BSD-any ~ notice ~ licen ~ (?:licensed|released|distributed|available|published|issued) under (?:the )?(?:terms of )?(?:a |the )?BSD(?:-style)? Licen[sc]e
BSD-any ~ notice ~ licen ~ use of this source code is governed by a BSD-style license
BSD-3-Clause ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause/?
BSD-2-Clause ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause/?
BSD-any ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/bsd-license(?:\.\w+)?
BSD-3-Clause ~ name ~ bsd ~ \b(?:3-clause|three-clause|new|modified|revised) BSD(?: licen[sc]e)?\b
BSD-3-Clause ~ name ~ bsd ~ \bBSD[- ]3[- ]Clause\b
BSD-2-Clause ~ name ~ bsd ~ \b(?:2-clause|two-clause|simplified) BSD(?: licen[sc]e)?\b
BSD-2-Clause ~ name ~ bsd ~ \bBSD[- ]2[- ]Clause\b
BSD-4-Clause ~ name ~ bsd ~ \b(?:4-clause|four-clause|original) BSD(?: licen[sc]e)?\b
BSD-any ~ mention ~ bsd+licen ~ \bBSD(?:-style)? licen[sc]e\b
# Mozilla, Eclipse and other weak copyleft
MPL-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?MPL-2\.0
MPL-1.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?MPL-1\.1
EPL-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?EPL-2\.0
EPL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?EPL-1\.0
CDDL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CDDL-1\.0
CDDL-1.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CDDL-1\.1
EUPL-1.2 ~ tag ~ spdx ~ SPDX-License-Identifier: ?EUPL-1\.2
EUPL-1.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?EUPL-1\.1
MS-PL ~ tag ~ spdx ~ SPDX-License-Identifier: ?MS-PL
MS-RL ~ tag ~ spdx ~ SPDX-License-Identifier: ?MS-RL
OSL-3.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?OSL-3\.0
AFL-3.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?AFL-3\.0
Artistic-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?Artistic-2\.0
PostgreSQL ~ tag ~ spdx ~ SPDX-License-Identifier: ?PostgreSQL
Python-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?(?:Python|PSF)-2\.0
OpenSSL ~ tag ~ spdx ~ SPDX-License-Identifier: ?OpenSSL
OFL-1.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?OFL-1\.1
CECILL-2.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CECILL-2\.1
MulanPSL-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?MulanPSL-2\.0
ECL-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?ECL-2\.0
NCSA ~ tag ~ spdx ~ SPDX-License-Identifier: ?NCSA
Unicode-3.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?Unicode-(?:3\.0|DFS-2016)
MPL-2.0 ~ notice ~ mozilla ~ This Source Code Form is subject to the terms of the Mozilla Public License, v\. ?2\.0
MPL-1.1 ~ notice ~ mozilla ~ The contents of this file are subject to the Mozilla Public License Version 1\.1
MPL-2.0 ~ notice ~ mozilla ~ (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?Mozilla Public Licen[sc]e,? (?:version|v\.?)? ?2(?:\.0)?
EPL-2.0 ~ notice ~ eclipse ~ made available under the terms of the Eclipse Public License (?:v\.? ?|version )?2\.0
EPL-1.0 ~ notice ~ eclipse ~ made available under the terms of the Eclipse Public License (?:v\.? ?|version )?1\.0
CDDL-any ~ notice ~ cddl,development+distribution ~ subject to the terms of the Common Development and Distribution License
EUPL-1.2 ~ notice ~ eupl ~ licensed under the EUPL,? (?:version|v\.?)? ?1\.2
MPL-2.0 ~ url ~ mozilla.org ~ https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0/?
MPL-1.1 ~ url ~ mozilla.org ~ https?://(?:www\.)?mozilla\.org/MPL/(?:1\.1/?|MPL-1\.1\.html)
EPL-2.0 ~ url ~ eclipse.org ~ https?://(?:www\.)?eclipse\.org/legal/epl-2\.0/?
EPL-1.0 ~ url ~ eclipse.org ~ https?://(?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
CDDL-1.0 ~ url ~ opensource.org ~ https?://(?:www\.)?opensource\.org/licenses/cddl1?(?:\.\w+)?
MPL-2.0 ~ name ~ mozilla ~ Mozilla Public Licen[sc]e,? (?:version|v\.?)? ?2(?:\.0)?
MPL-1.1 ~ name ~ mozilla ~ Mozilla Public Licen[sc]e,? (?:version|v\.?)? ?1\.1
MPL-2.0 ~ name ~ mpl ~ \bMPL[- ]?(?:v|version )?2(?:\.0)?\b
EPL-2.0 ~ name ~ eclipse+licen ~ Eclipse Public Licen[sc]e,? (?:-? ?v\.? ?|version )?2(?:\.0)?
EPL-1.0 ~ name ~ eclipse+licen ~ Eclipse Public Licen[sc]e,? (?:-? ?v\.? ?|version )?1(?:\.0)?
CDDL-1.0 ~ name ~ cddl ~ \bCDDL[- ]?(?:v|version )?1\.0\b
CDDL-1.1 ~ name ~ cddl ~ \bCDDL[- ]?(?:v|version )?1\.1\b
CDDL-any ~ name ~ development+distribution ~ Common Development and Distribution Licen[sc]e
EUPL-1.2 ~ name ~ european+licen ~ European Union Public Licen[sc]e,? (?:version|v\.?)? ?1\.2
EUPL-any ~ mention ~ european+licen ~ European Union Public Licen[sc]e
MS-PL ~ name ~ microsoft+licen ~ Microsoft Public Licen[sc]e(?: \(Ms-PL\))?
MS-RL ~ name ~ microsoft+licen ~ Microsoft Reciprocal Licen[sc]e(?: \(Ms-RL\))?
OSL-3.0 ~ name ~ licen ~ Open Software Licen[sc]e,? (?:version|v\.?)? ?3\.0
AFL-3.0 ~ name ~ academic+licen ~ Academic Free Licen[sc]e,? (?:version|v\.?)? ?3\.0
Artistic-2.0 ~ name ~ artistic+licen ~ (?:The )?Artistic Licen[sc]e,? (?:version|v\.?)? ?2(?:\.0)?
Artistic-1.0 ~ name ~ artistic+licen ~ (?:The )?Artistic Licen[sc]e,? (?:version|v\.?)? ?1(?:\.0)?
Artistic-any ~ mention ~ artistic+licen ~ (?:The )?Artistic Licen[sc]e
PostgreSQL ~ name ~ postgresql+licen ~ PostgreSQL Licen[sc]e
Python-2.0 ~ name ~ psf+licen,python+licen ~ (?:PSF|Python Software Foundation) Licen[sc]e(?: Agreement)?(?: (?:version|v\.?)? ?2)?
PHP-3.01 ~ name ~ php+licen ~ PHP Licen[sc]e,? (?:version|v\.?)? ?3\.0?1
Ruby ~ name ~ ruby+licen ~ \bRuby(?:'s)? Licen[sc]e\b
OpenSSL ~ name ~ openssl+licen ~ OpenSSL Licen[sc]e
OFL-1.1 ~ name ~ licen ~ SIL Open Font Licen[sc]e,? (?:version|v\.?)? ?1\.1
OFL-1.1 ~ url ~ sil.org ~ https?://scripts\.sil\.org/OFL/?
CECILL-any ~ name ~ cecill ~ \bCeCILL(?:-[BC])?(?: (?:version|v\.?)? ?2(?:\.[01])?)?\b
MulanPSL-2.0 ~ name ~ mulan ~ Mulan (?:Permissive Software License|PSL),? (?:version|v\.?)? ?2
ECL-2.0 ~ name ~ educational+licen ~ Educational Community Licen[sc]e,? (?:version|v\.?)? ?2\.0
NCSA ~ name ~ illinois,ncsa ~ University of Illinois/NCSA Open Source Licen[sc]e
CPL-1.0 ~ name ~ licen ~ Common Public Licen[sc]e,? (?:version|v\.?)? ?1\.0
IPL-1.0 ~ name ~ ibm+licen ~ IBM Public Licen[sc]e,? (?:version|v\.?)? ?1\.0
QPL-1.0 ~ name ~ licen ~ \bQ Public Licen[sc]e\b
Sleepycat ~ name ~ sleepycat ~ Sleepycat Licen[sc]e
Vim ~ name ~ vim+licen ~ \bVim Licen[sc]e\b
JSON ~ text ~ evil ~ The Software shall be used for Good, not Evil
MPL-any ~ mention ~ mozilla ~ Mozilla Public Licen[sc]e
EPL-any ~ mention ~ eclipse+licen ~ Eclipse Public Licen[sc]e
OFL-any ~ mention ~ licen ~ Open Font Licen[sc]e
# Creative Commons
CC0-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC0-1\.0
CC-BY-4.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC-BY-4\.0
CC-BY-SA-4.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC-BY-SA-4\.0
CC-BY-NC-4.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC-BY-NC-4\.0
CC-BY-ND-4.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC-BY-ND-4\.0
CC-BY-NC-SA-4.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC-BY-NC-SA-4\.0
CC-BY-NC-ND-4.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?CC-BY-NC-ND-4\.0
CC-BY-NC-ND-4.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY[- ]NC[- ]ND|Creative Commons Attribution[- ]Non-?Commercial[- ]No-?Deriv(?:ative)?s?(?: Works)?)(?: Licen[sc]e,?)?(?: International)?,? ?(?:version |v\.?)?4\.0
CC-BY-NC-SA-4.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY[- ]NC[- ]SA|Creative Commons Attribution[- ]Non-?Commercial[- ]Share-?Alike)(?: Licen[sc]e,?)?(?: International)?,? ?(?:version |v\.?)?4\.0
CC-BY-NC-4.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY[- ]NC|Creative Commons Attribution[- ]Non-?Commercial)(?: Licen[sc]e,?)?(?: International)?,? ?(?:version |v\.?)?4\.0
CC-BY-SA-4.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY[- ]SA|Creative Commons Attribution[- ]Share-?Alike)(?: Licen[sc]e,?)?(?: International)?,? ?(?:version |v\.?)?4\.0
CC-BY-SA-3.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY[- ]SA|Creative Commons Attribution[- ]Share-?Alike)(?: Licen[sc]e,?)?(?: Unported)?,? ?(?:version |v\.?)?3\.0
CC-BY-ND-4.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY[- ]ND|Creative Commons Attribution[- ]No-?Deriv(?:ative)?s?)(?: Licen[sc]e,?)?(?: International)?,? ?(?:version |v\.?)?4\.0
CC-BY-4.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY|Creative Commons Attribution)(?: Licen[sc]e,?)?(?: International)?,? ?(?:version |v\.?)?4\.0
CC-BY-3.0 ~ notice ~ creative+under,cc+by+under ~ (?:licensed|released|distributed|available|published|shared) under (?:a |the )?(?:CC[- ]BY|Creative Commons Attribution)(?: Licen[sc]e,?)?(?: Unported)?,? ?(?:version |v\.?)?3\.0
CC0-1.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/publicdomain/zero/1\.0/?(?:legalcode)?
CC-PDM-1.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/publicdomain/mark/1\.0/?
CC-BY-NC-ND-4.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-NC-SA-4.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-4.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-SA-4.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-SA-3.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-ND-4.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-4.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by/4\.0/?
CC-BY-3.0 ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/by/3\.0/?
CC-any ~ url ~ creativecommons.org ~ https?://creativecommons\.org/licenses/[a-z-]+/\d\.\d/?
CC-BY-NC-ND-4.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]NC[- ]ND[- ]4\.0\b
CC-BY-NC-SA-4.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]NC[- ]SA[- ]4\.0\b
CC-BY-NC-4.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]NC[- ]4\.0\b
CC-BY-SA-4.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]SA[- ]4\.0\b
CC-BY-ND-4.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]ND[- ]4\.0\b
CC-BY-4.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]4\.0\b
CC-BY-SA-3.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]SA[- ]3\.0\b
CC-BY-3.0 ~ name ~ cc+by ~ \bCC[- ]BY[- ]3\.0\b
CC0-1.0 ~ name ~ cc0 ~ \bCC0(?:[- ]1\.0)?\b
CC0-1.0 ~ name ~ creative+zero ~ Creative Commons Zero(?: v?1\.0)?
CC-any ~ mention ~ creative ~ Creative Commons(?: Attribution)?(?:[- ](?:Non-?Commercial|Share-?Alike|No-?Derivatives))*(?: Licen[sc]e)?
CC-any ~ mention ~ cc+by ~ \bCC[- ]BY(?:[- ](?:NC|SA|ND))*\b
# data and model licences
ODbL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?ODbL-1\.0
ODC-By-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?ODC-By-1\.0
PDDL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?PDDL-1\.0
ODbL-1.0 ~ name ~ database+licen ~ Open (?:Data Commons Open )?Database Licen[sc]e(?: \(ODbL\))?(?:,? v?1\.0)?
ODC-By-1.0 ~ name ~ commons+licen ~ Open Data Commons Attribution Licen[sc]e(?:,? v?1\.0)?
PDDL-1.0 ~ name ~ dedication+licen ~ Open Data Commons Public Domain Dedication and Licen[sc]e
OGL-UK-3.0 ~ name ~ government+licen ~ Open Government Licen[sc]e,? ?(?:version |v\.?)?3\.0
OGL-any ~ mention ~ government+licen ~ Open Government Licen[sc]e
CDLA-Permissive-2.0 ~ name ~ community+data ~ Community Data License Agreement ?[-–] ?Permissive
CDLA-Sharing-1.0 ~ name ~ community+data ~ Community Data License Agreement ?[-–] ?Sharing
OpenRAIL-M ~ name ~ openrail ~ \bOpenRAIL(?:-?M|\+\+)?\b
BigScience-RAIL-1.0 ~ name ~ bigscience ~ BigScience (?:Open)?RAIL(?:-M)? Licen[sc]e
ODbL-1.0 ~ url ~ opendatacommons ~ https?://(?:www\.)?opendatacommons\.org/licenses/odbl/?(?:1[.-]0/?)?
ODC-By-1.0 ~ url ~ opendatacommons ~ https?://(?:www\.)?opendatacommons\.org/licenses/by/?(?:1[.-]0/?)?
# source available and closed terms
BUSL-1.1 ~ tag ~ spdx ~ SPDX-License-Identifier: ?BUSL-1\.1
SSPL-1.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?SSPL-1\.0
Elastic-2.0 ~ tag ~ spdx ~ SPDX-License-Identifier: ?Elastic-2\.0
BUSL-1.1 ~ name ~ business+licen ~ Business Source Licen[sc]e(?: 1\.1)?
SSPL-1.0 ~ name ~ server+licen ~ Server Side Public Licen[sc]e(?:,? ?v(?:ersion)? ?1)?
Elastic-2.0 ~ name ~ elastic+licen ~ Elastic Licen[sc]e,? ?(?:version |v\.?)?2(?:\.0)?
Commons-Clause ~ name ~ commons+clause ~ Commons Clause(?: Licen[sc]e)?(?: Condition)?
PolyForm-Noncommercial-1.0.0 ~ name ~ polyform ~ PolyForm Noncommercial Licen[sc]e(?: 1\.0\.0)?
PolyForm-any ~ mention ~ polyform ~ PolyForm [A-Z][a-z]+ Licen[sc]e
Proprietary ~ notice ~ proprietary ~ (?:this (?:document|file|software|work|code) )?(?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?(?: of| to)?
Proprietary ~ notice ~ unauthori ~ unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?:of|or) [a-z ]{1,60})? (?:is|are) (?:strictly )?prohibited
Proprietary ~ notice ~ prohibited ~ (?:redistribution|reproduction|copying)(?: or [a-z]+)? (?:without (?:prior )?(?:written )?permission )?is (?:strictly )?prohibited
Proprietary ~ notice ~ permission ~ may not be (?:copied|reproduced|redistributed|republished)(?:,? (?:or|copied|reproduced|distributed|republished|published))* without (?:the )?(?:express |prior )?(?:written )?permission
Proprietary ~ name ~ end-user ~ End-User Licen[sc]e Agreement
Proprietary ~ mention ~ proprietary ~ proprietary (?:software|licen[sc]e)
All-rights-reserved ~ notice ~ reserved ~ (?:copyright|©|\(c\))[^\n]{0,80}?all rights reserved
All-rights-reserved ~ weak ~ reserved ~ all rights reserved
All-rights-reserved ~ weak ~ droits+réservés ~ tous droits réservés
All-rights-reserved ~ weak ~ rechte+vorbehalten ~ alle rechte vorbehalten
All-rights-reserved ~ weak ~ reservados+derechos ~ todos los derechos reservados
Public-domain ~ notice ~ domain ~ (?:released|placed|dedicated|put) (?:in|into|to) the public domain
Public-domain ~ name ~ domain ~ this (?:work|file|software|document|code) is (?:in|part of) the public domain
Public-domain ~ weak ~ domain ~ public domain
Unknown ~ weak ~ licen ~ (?:see|refer to) (?:the )?(?:accompanying |included |file )?LICEN[SC]E(?:\.\w+)?(?: file)? for (?:more )?(?:details|terms|information)
Unknown ~ weak ~ licen ~ licensed under (?:the )?(?:terms of )?(?:the )?[A-Z][\w.-]*(?: [A-Z0-9][\w.-]*){0,5} licen[sc]e
"""
