"""Templates for the license scan: (license, form, text)."""

from .license_bodies import BODIES

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version {} of the License, or (at
your option) any later version."""

AGPL = GPL.replace("General", "Affero General")

LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version {} of the License,
or (at your option) any later version."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""

ZLIB = """Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions"""

BOOST = "Distributed under the Boost Software License, Version 1.0."

TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "text", MIT),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "grant", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", APACHE),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "line", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "line", "Licensed under the BSD 2-Clause License."),
    ("GPL-2.0", "notice", GPL.format(2)),
    ("GPL-3.0", "notice", GPL.format(3)),
    ("GPL-2.0", "line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "notice", LGPL.format("2.1")),
    ("LGPL-3.0", "notice", LGPL.format(3)),
    ("AGPL-3.0", "notice", AGPL.format(3)),
    ("MPL-2.0", "notice", MPL),
    ("ISC", "text", ISC),
    ("Unlicense", "text", UNLICENSE),
    ("Zlib", "text", ZLIB),
    ("BSL-1.0", "line", BOOST),
    ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "line", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "line", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    *[(name, "full", text) for name, text in BODIES.items()],
]
