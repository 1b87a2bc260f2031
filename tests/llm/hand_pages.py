"""Pages written by hand, each with its main text. The generator of training pages makes none of these layouts as it stands here."""

HAND_WRITTEN = {
    "header in an article": (
        """<!doctype html><html><head><title>Bees</title><script>var a = "<p>no</p>";</script></head><body class="single">
<header class="site"><a href="/">The Garden Post</a><nav><a href="/">Home</a> <a href="/about">About us</a></nav></header>
<main><article><header><h1>Why bees dance</h1></header>
<p>A bee that has found flowers tells the others where they are.</p><p>It walks in a figure of eight, and the angle shows the way.</p>
<h2>How it was found</h2><p>Karl von Frisch watched them for twenty years before he was sure.</p></article>
<aside class="related"><h3>More</h3><ul><li><a href="/1">Wasps</a></li><li><a href="/2">Ants</a></li></ul></aside></main>
<footer><p>&copy; 2020 The Garden Post. All rights reserved.</p></footer></body></html>""",
        "Why bees dance\nA bee that has found flowers tells the others where they are.\nIt walks in a figure of eight, and the angle shows the way.\nHow it was found\nKarl von Frisch watched them for twenty years before he was sure.",
    ),
    "divs only": (
        """<html><body><div id="top"><div class="menu"><a href="/">Start</a><a href="/news">News</a></div></div>
<div id="content"><div class="post"><h1>The bridge is closed</h1><div>The old bridge over the river will be closed until the end of May.</div>
<div>Engineers found cracks in two of its pillars during the spring survey.</div><div>Buses will take the road through the valley instead.</div></div></div>
<div id="sidebar"><div>Weather: rain</div><div>Most read this week</div></div><div class="cookie-banner">We use cookies. <button>OK</button></div><div class="footer">Imprint</div></body></html>""",
        "The bridge is closed\nThe old bridge over the river will be closed until the end of May.\nEngineers found cracks in two of its pillars during the spring survey.\nBuses will take the road through the valley instead.",
    ),
    "tables and lists": (
        """<body><nav><ul><li><a href=a>Recipes</a><li><a href=b>Shop</a></ul></nav><article><h1>Rye bread</h1><p>This loaf keeps for a week.</p>
<table><tr><th>What</th><th>How much</th></tr><tr><td>Rye flour</td><td>500 g</td></tr><tr><td>Water</td><td>350 ml</td></tr></table>
<ol><li>Mix the flour with the water.<li>Let it rest over night.<li>Bake it for an hour.</ol></article>
<section class="comments"><h2>2 comments</h2><div class="comment"><b>Ann</b><p>Mine was too wet, what did I do wrong?</p></div><div class="comment"><b>Bo</b><p>Less water next time.</p></div></section></body>""",
        "Rye bread\nThis loaf keeps for a week.\nWhat\nHow much\nRye flour\n500 g\nWater\n350 ml\nMix the flour with the water.\nLet it rest over night.\nBake it for an hour.",
    ),
    "no container": (
        """<title>Notes</title><div class="nav"><a href="/">Index</a> | <a href="/2">Next</a></div><h1>Notes on clocks</h1>
<p>A clock that is right twice a day is still worth having.<p>The first ones had a single hand.<p>Minutes came later, with the pendulum.
<div class="ads">Buy a watch today and save half of the price!</div><p>Seconds were for astronomers.<div id="footer">Copyright by the author</div>""",
        "Notes on clocks\nA clock that is right twice a day is still worth having.\nThe first ones had a single hand.\nMinutes came later, with the pendulum.\nSeconds were for astronomers.",
    ),
    "another script": (
        """<html><body><div class="header"><a href="/">新聞</a></div><div class="main"><div class="article"><h1>春の山を歩く</h1><p>四月の山にはまだ雪が残っている。朝早く宿を出て、谷沿いの道を登った。</p>
<p>頂上からは海が見えた。風は冷たかったが、空は晴れていた。</p></div><div class="related"><h3>関連記事</h3><ul><li><a href="/a">夏の山</a></li></ul></div></div><div class="footer">著作権 &copy; 2021</div></body></html>""",
        "春の山を歩く\n四月の山にはまだ雪が残っている。朝早く宿を出て、谷沿いの道を登った。\n頂上からは海が見えた。風は冷たかったが、空は晴れていた。",
    ),
    "bad markup": (
        """<body><div it's class=menu><a href="/>Home</a> <a href="/x">More</a></div><article title=it's><h1>Stray quotes</h1><p class="a>The first paragraph is here.</p><p class="b">And the second one follows it.</p>
<p>A third <b>bold one<p>and a fourth.</article><form><select><option>One<option>Two</form><footer>&copy; me</footer>""",
        "Stray quotes\nThe first paragraph is here.\nAnd the second one follows it.\nA third bold one\nand a fourth.",
    ),
    "deeply wrapped": (
        "<body>" + '<div class="x">' * 30 + '<div class="navigation"><a href="/">Up</a></div>' + '<div role="main"><h1>Far inside</h1>' + "<div>" * 15 + "<p>Some builders wrap a text in many boxes.</p><p>It is still the text of the page.</p>" + "</div>" * 15
        + '</div><div class="comments">' + "<div>" * 15 + "<p>I read this on my phone and it works.</p><p>So do I, thank you.</p>" + "</div>" * 15 + "</div>" + "</div>" * 30 + "</body>",
        "Far inside\nSome builders wrap a text in many boxes.\nIt is still the text of the page.",
    ),
}
