"""Notices, grants and passages by which works state their licenses, as (license, text). Public license wording.

Licenses that share most of their wording are told apart by passages of their own; what they share is named by family.
"""

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
    ),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    (
        "Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
        "royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
        "distribute the Work and such Derivative Works in Source or Object form.",
    ),
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "BSD",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "GPL-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical "
        "works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your "
        "freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ),
    (
        "AGPL-3.0",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation "
        "with the community in the case of network server software.",
    ),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License"),
    (
        "GPL-2.0",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended "
        "to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    (
        "LGPL",
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software "
        "Foundation and other authors who decide to use it.",
    ),
    (
        "LGPL",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, "
        "supplemented by the additional permissions listed below.",
    ),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    (
        "MPL-2.0",
        "under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, "
        "perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work",
    ),
    (
        "EPL",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM '
        "CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license",
    ),
]

#: Identifiers by which files name their license in one line, by the license that is reported.
SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "Zlib": ["Zlib"], "BSL-1.0": ["BSL-1.0"], "BSD": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"],
    "GPL-2.0": ["GPL-2.0"], "GPL-3.0": ["GPL-3.0"], "LGPL": ["LGPL-2.1", "LGPL-3.0"], "AGPL-3.0": ["AGPL-3.0"], "MPL-2.0": ["MPL-2.0"], "EPL": ["EPL-1.0", "EPL-2.0"],
    "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC0-1.0": ["CC0-1.0"],
}
TEMPLATES += [(license_, f"SPDX-License-Identifier: {tag}") for license_, tags in SPDX.items() for tag in tags]
