"""Licence notices: label, name, text.

These are fixed values, the notices that the licences themselves ask to be put into files (opening and conditions), and the short lines
that stand for them.
"""

#: The phrases that count wherever they stand, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

TEMPLATES = (
    ("mit", "mit-line", "Released under the MIT License."),
    ("mit", "mit-line-2", "This project is licensed under the terms of the MIT License."),
    (
        "mit",
        "mit-grant",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ),
    ("apache", "apache-line", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "apache-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("gpl", "gpl-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gpl-line-2", "This program is licensed under the GNU General Public License, version 2."),
    (
        "gpl",
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "lgpl",
        "lgpl-notice",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "agpl",
        "agpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Affero General Public License for more details.""",
    ),
    (
        "bsd",
        "bsd-conditions",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ),
    ("bsd", "bsd-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "isc",
        "isc-grant",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "mpl",
        "mpl-notice",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("cc-by", "cc-by-line", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "cc-by-sa-line", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "cc0-line", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "unlicense-line", "This is free and unencumbered software released into the public domain."),
    ("reserved", "all-rights-reserved", "All rights reserved. No part of this publication may be reproduced without permission."),
)
