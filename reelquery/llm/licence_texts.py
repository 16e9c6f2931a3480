"""Fixed values from which licence paragraphs are made: names of licences, wordings that grant one, texts, and paragraphs that
only speak of licences. Everything here is public licence wording; the examples are built from it by rule in licenses.py."""

#: Family -> names by which its licences are called.
NAMES = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache 2.0", "Apache Software License", "Apache License", "ASL 2.0", "Apache v2"),
    "mit": ("MIT License", "MIT license", "MIT licence", "MIT", "MIT/X11 license", "Expat license", "X11 License", "MIT-style license", "terms of the MIT License"),
    "gpl": (
        "GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GNU GPL version 2 or later", "GNU GPLv3", "GPL", "GPLv2", "GPLv3", "GPL v3",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL version 3", "General Public License",
    ),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL 2.1 or later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "LGPLv3", "LGPL version 2.1", "Lesser GPL"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "Affero GPL"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "New BSD License", "Simplified BSD License", "BSD-style license", "BSD", "modified BSD licence"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL", "MPL 2.0", "MPL-2.0", "MPL-1.1", "MPLv2"),
    "isc": ("ISC License", "ISC license", "ISC licence", "ISC"),
    "zlib": ("zlib License", "zlib/libpng license", "zlib licence", "Zlib"),
    "boost": ("Boost Software License", "Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0", "Boost license"),
    "epl": ("Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "EPL", "EPL-1.0", "EPL-2.0", "EPL 2.0"),
    "eupl": ("European Union Public Licence", "European Union Public Licence, version 1.2", "EUPL", "EUPL-1.2", "EUPL, version 1.2", "EUPL v1.1"),
    "cc-by": (
        "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution-ShareAlike 4.0 International License",
        "Creative Commons Attribution Share Alike licence", "CC BY", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA", "CC BY-ND 4.0",
    ),
    "cc-by-nc": (
        "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution Non-Commercial licence",
        "CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0", "CC BY-NC 3.0",
    ),
    "gfdl": ("GNU Free Documentation License", "GNU Free Documentation License, Version 1.3", "GNU FDL", "GFDL", "GFDL-1.3", "FDL 1.2", "Free Documentation License"),
    "public-domain": ("CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication", "Unlicense", "The Unlicense"),
}
#: Families whose names are never shown to the fit: what they hold is unknown, and calibration learns from that.
UNSEEN = ("Artistic License 2.0", "Common Development and Distribution License", "CeCILL licence", "Open Software License 3.0", "Microsoft Public License", "Academic Free License", "Q Public License", "Sleepycat License")
#: Made-up names in the same wordings: unknown, so that the wording alone is no evidence.
INVENTED = ("Acme License", "Foo Public License 2.0", "Company License Agreement", "custom licence", "same license as the original", "license of the vendor", "terms of the contract", "name of the author", "Example License, version 1.0")
#: Wordings that grant what stands in {}: those of the fit, and those that calibration keeps for itself.
WORDINGS = (
    "Licensed under the {}.", "Licensed under {}", "licensed under {}, see the file LICENSE", "Released under the {}.", "Released under {}.", "This project is released under the {}.", "Distributed under the {}.",
    "distributed under {}", "This work is licensed under a {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "SPDX-License-Identifier: {}", "License: {}", "Available under {}.",
    "Use of this source code is governed by a {} that can be found in the LICENSE file.", "Published under the {}.", "You can use it under the terms of the {}.", "Dual licensed under {} or a commercial license",
    "The program is free software under the {}.", "{} applies to all files here.", "This project is {} licensed.", "{} licensed software", "Copyright (c) 2015 the authors. {}.", "{} licence covers the files.",
    "The {} license applies.", "Lizenziert nach der {}.", "Dieses Programm steht unter der {} Lizenz.", "Publié sous licence {}.", "Publicado bajo licencia {}.",
    "The library is {} licensed.", "everything here is {} licensed", "Unter der {}-Lizenz veröffentlicht.", "Lizenz: {}", "lizenziert unter der {}", "(c) 2010 Example Inc. {}", "(c) 1999 by the team. {}.", "{} licence applies to this.",
    "Our code is {} licensed.", "{} licensed.", "is {} licensed", "(c) 2003 Jane. {}.", "(c) 2020 Corp. {}.", "(c) Smith. {}",
)
CALIBRATION_WORDINGS = ("All code here is made available under the {}.", "licensed {}", "This package is covered by the {}.", "Source files carry the {}.", "The contents of this file are subject to the {}", "It is offered under {}.", "Our library is {} licensed", "(c) 2012 Jane Roe. {}.", "Das Paket ist unter der {} lizenziert.")
#: Family -> what its licences or their notices say, paragraph by paragraph.
TEXTS = {
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Covered Software is provided under this License on an as is basis, without warranty of any kind, either expressed, implied, or statutory.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "boost": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.',
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "eupl": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL; you may not use this work except in compliance with the Licence.",),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
        "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit and indicate if changes were made.",
    ),
    "cc-by-nc": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "You are free to share and adapt the material, but you may not use the material for commercial purposes.",
    ),
    "gfdl": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        'A copy of the license is included in the section entitled "GNU Free Documentation License".',
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain.",
        "Released into the public domain.",
        "The author places this file in the public domain.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright by the author. All rights reserved.", "Copyright 2020 by the publisher, all rights reserved worldwide.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Unauthorized reproduction or distribution of this material is prohibited.",
    ),
}
#: Things that have licences, names or rights of another kind, and sentences around them.
THINGS = ("driver", "fishing", "hunting", "pilot", "broadcasting", "marriage", "taxi", "dog", "television", "trading")
AROUND = (
    "He lost his {} license.", "A {} license costs twenty euros a year.", "She applied for a {} licence in May.", "The {} licence was revoked by the court.", "Without a {} license you may not work here.",
    "The office that issues the {} license is closed.", "Everyone with a {} licence got a letter.",
)
#: Places where things can be "under", so that the words around a grant say nothing alone.
PLACES = ("the bridge", "the name of his wife", "the table", "a new title", "the old law", "the trees", "pressure", "the direction of the mayor", "contract", "the moon")
UNDER = ("The report was released under {}.", "Food was distributed under {}.", "It was published under {}.", "The boat is available under {}.", "The project was governed under {}.", "They worked under {}.")
#: Sentences that speak of what stands in {} without granting anything: those of the fit, and those that calibration keeps.
SPEAKING = (
    "{} is a bad choice for us.", "The history of {} is long and odd.", "Many people dislike {}.", "An article about {} appeared in the paper.", "They argued about {} all evening.", "What is {}, she asked.",
    "{} was discussed at the conference.", "The {} level is 9.", "Some say that {} will win.", "The {} crew landed in the valley.", "He wrote a book on {} in 2004.", "We moved away from {} last year.", "Is {} older than the web?", "Many companies prefer the {}.", "The {} is shorter than that one.",
)
CALIBRATION_SPEAKING = ("Nobody understood {} at first.", "{} is a good idea, others think.", "The {} setting has no effect.", "A talk on {} was given in Paris.", "The {} team walked over the hill.")
#: Words of which a paragraph holds one where it grants what it names; a name alone confirms nothing.
GRANTING = (
    "applies", "available", "bajo", "c", "copyright", "covered", "covers", "distributed", "distribution", "governed", "grant", "granted", "licence", "licences", "license", "licensed", "licenses", "licencia", "lizenz",
    "lizenziert", "offered", "permission", "published", "released", "sous", "spdx", "terms",
)
#: Paragraphs that share words with licences without granting one, and plain prose.
OTHERS = (
    "The general said the public would be informed about the version of events.", "Permission to enter the building is granted by the office.", "The warranty on this car covers three years.",
    "Public transport is free of charge on Sunday.", "The terms of the agreement were published by the foundation.", "He reserved a table, and all the others were reserved too.",
    "Copies of the documentation may be obtained from any person at the desk.", "The software was used without restriction in the following years.", "A common licence fee is paid for television.",
    "The source of the river is subject to dispute.", "Human rights are the subject of this work.", "The Apache helicopter flew over the city.", "MIT is a university in Cambridge.", "Researchers at MIT published a study.",
    "Version 2.0 of the program was released in May.", "Version 3 of the software is available now.", "The creative writing course is for the common reader.", "Mozilla released a new version of its browser.",
    "The eclipse could be seen by the public in the whole of the European Union.", "A boost of the economy was expected by the union.", "She studied at the university and worked for the commission.",
    "Software is written by people.", "The file is in the folder of the project.", "You can use the code to open the door.", "See the file for more details.", "This project is about the history of the city.",
    "The work was finished in the evening, and we went home.", "The copyright law of the country was changed last year.", "A gnu is a large animal of Africa.", "The artist gave the rights to a museum.",
    "Commercial use of the road is limited to buses.", "The contents of the box are listed on the lid.", "Attribution of the painting to the master is disputed.", "The domain of the function is the set of all numbers.",
    "nothing of that kind", "it was a dark night and the rain fell in the streets", "the author of the book", "Er hat den Bus verpasst und kam zu spät nach Hause.", "Sie fährt mit dem Zug in die Stadt und kommt am Abend wieder.",
    "Er ging mit ihr in den Park.", "Kaffee mit Milch und Zucker, bitte.", "Das Haus mit dem roten Dach ist alt.", "mit der Zeit wird alles gut", "Komm mit mir nach Hause.", "Was ist mit dir und mit den anderen?",
    "Je ne sais pas pourquoi il est parti si tôt.", "La maison est grande et le jardin est beau.", "El perro duerme en la casa y no quiere salir.", "La ciudad es muy bonita en el verano.", "", "1", "foo bar baz",
)
#: The same, kept from the fit for calibration.
CALIBRATION_OTHERS = (
    "The license plate of the car was found in the river.", "A licensed physician must be present.", "The bar lost its liquor licence in June.", "Public access to the source of the data was denied.", "All rights of the tenants are protected by law.",
    "The permission slip must be signed by a parent.", "His version of the story was published in the paper.", "The students of MIT won the prize.", "Creative people commonly work at night.", "The BSD conference takes place in autumn.",
    "The program of the evening is subject to change without notice.", "We were free to use the kitchen for any purpose.", "The library is open to the general public.", "The contract was signed under the terms of the seller.", "The shop sells software and books.",
    "Das Haus steht am Rand des Waldes.", "Sie spricht mit ihrem Bruder.", "Ein Mann mit Hut kam mit dem Hund.", "und mit der Bahn", "Le train part à huit heures.", "Los libros están en la mesa.", "the second word of the sentence", "A lesser man would have given up.", "The union of the workers met the general of the army.",
    "Affected areas include the north and the west.", "No part of the island was dry.", "Reproduction of the animals takes place in spring.", "He was licensed to fly, and distributed leaflets from the air.",
)
#: Words that say nothing without others: n-grams of these and of numbers alone are no features.
FUNCTION_WORDS = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "do", "for", "from", "give", "has", "have", "her", "his", "if", "in", "is", "it", "its", "long", "made", "may", "must", "no", "not", "of", "on", "or", "other",
    "shall", "that", "the", "their", "there", "these", "they", "this", "those", "to", "under", "was", "were", "which", "who", "whom", "will", "with", "you", "your",
)
