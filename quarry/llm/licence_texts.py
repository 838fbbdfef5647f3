"""Fixed values of the licence scan: notices of each licence family as commonly published, a paragraph each, and sentences near to them."""

from __future__ import annotations


def _gnu(name: str, thing: str) -> list[str]:
    """The three paragraphs that stand at the head of files under a GNU licence, and how it is cited."""
    return [
        f"Licensed under the GNU {name}, version 3.",
        f"This work is licensed under the GNU {name}, version 3.",
        f"This project is released under the terms of the GNU {name} v3.0 or later.",
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation",
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}",
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"You should have received a copy of the GNU {name} along with this {thing}. If not, see https://www.gnu.org/licenses/.",
    ]


def _commons(short: str, long: str, path: str) -> list[str]:
    return [
        f"Licensed under CC {short} 4.0.",
        f"This text is available under the CC {short} license.",
        f"This work is licensed under a Creative Commons {long} 4.0 International License.",
        f"Except where otherwise noted, content on this site is licensed under the Creative Commons {long} license.",
        f"To view a copy of this license, visit https://creativecommons.org/licenses/{path}/4.0/.",
        f"SPDX-License-Identifier: CC-{short.replace(' ', '-')}-4.0",
    ]


TEMPLATES: dict[str, list[str]] = {
    "AGPL": [*_gnu("Affero General Public License", "program"), "SPDX-License-Identifier: AGPL-3.0-or-later", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": _commons("BY", "Attribution", "by"),
    "CC-BY-NC": _commons("BY-NC", "Attribution-NonCommercial", "by-nc"),
    "CC-BY-SA": _commons("BY-SA", "Attribution-ShareAlike", "by-sa"),
    "CC0": [
        "Released under CC0 1.0.",
        "CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        *_gnu("General Public License", "program"),
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [*_gnu("Lesser General Public License", "library"), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright the company. All rights reserved worldwide.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

#: Sentences with words of notices that grant nothing.
NEAR_MISSES = [
    "The driver showed a license to the officer.", "He was licensed to teach in this city.", "The press released a version of the story.", "The public library is free on Sundays.", "All rights of the guests are equal.",
    "A permission was granted by the school.", "The source of the river is public.", "The software was included in the price.", "Reserved seats are all taken.", "Apache helicopters flew over the general.", "She studied at MIT before.", "The work is subject to terms.",
    "A license may be required under local law.", "Commons were open to the public.", "Version 2.0 of the plan was published.", "The person was free to use the file.", "Copyright is a branch of the law that authors should know.", "The court heard a claim of copyright infringement.",
    "The warranty of the car ends next year.", "The house was sold without any warranty.", "Leaflets were distributed in the streets.", "Smoking is strictly prohibited in all rooms.", "The table was reserved for eight persons.", "The king had all rights in the domain.",
    "A fishing license costs more for visitors.", "The general public was not admitted.", "The owner is liable for any damages to the fence.", "Water and food were distributed free of charge.", "The debate in the House of Commons was long.", "The letter was marked confidential.", "The board renewed the license of the station.", "The license number was painted on the door.",
]
#: What notices stand after.
LEADS = ["", "This project is ", "The text is ", "Note: ", "Copyright 2020 the authors. ", "(c) 2019 ", "Code and data: "]

#: A paragraph without any of these words is not scored: each notice has one, and ordinary prose seldom does ("mit" is a German word, so names alone are none).
CUES = sorted(set("""
agpl cc0 commons confidential copyleft copyright copyrighted distribute distributed domain droits gpl lgpl liable licence licences license
licensed licenses licensing merchantability mozilla mpl permission permitted prohibited proprietary redistribute redistribution redistributions
reservados reserved spdx sublicense unencumbered unlicense vorbehalten warranties warranty
""".split()))  # fmt: skip
