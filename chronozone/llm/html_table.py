"""The labelled pages from which ``html`` trains its tree: a block's text begins with ``+`` if it is main text, else ``-``."""

PAGES = [
    """<html><body><header><a href=/>-Site name</a><p>-The daily paper of the valley</p></header><nav><ul><li><a href=/a>-Home</a></li><li><a href=/b>-World news</a></li><li><a href=/c>-Sports</a></li></ul></nav>
    <article><h1>+A short headline</h1><p>+One.</p><p>+The council met on Monday evening to talk about the bridge, and after three hours of debate the members agreed to wait until the spring.</p><p>+It was late.</p><h2>+What comes next</h2><p>+A second report is due in March, says <a href=/x>the office of the mayor</a>, and a vote may follow.</p></article>
    <aside><h3>-Most read</h3><a href=/1>-Ten ways to cook rice</a><p>-A long teaser about something else that has quite a number of words but is no part of the article at all.</p></aside><footer><p>-Copyright 2024 Site name. All rights reserved.</p><a href=/imprint>-Imprint</a></footer></body></html>""",
    """<html><body><div class="cookie-notice">-We use cookies to give you the best experience on our site. <a href=/p>Read our policy</a></div><div id="menu"><a href=/>-Start</a> | <a href=/shop>Shop</a></div>
    <main><h1>+Walking in the hills</h1><div class="ad">-Buy good boots now and save a lot of money, only this week.</div><p>+The path begins behind the church and climbs slowly through the wood. After an hour it comes out on the open ridge.</p><ul><li>+Bread</li><li>+Water and a map of the area</li></ul><blockquote>+We never met a soul.</blockquote><p>+Yes.</p><div class="related"><a href=/2>-Ten more walks</a><a href=/3>-Maps to buy</a></div></main>
    <section id="comments"><h3>-Two comments</h3><div class="comment"><p>-Lovely walk, we did it last summer with the children and the dog and liked it very much indeed.</p></div><form><label>-Your name</label><button>-Send</button></form></section></body></html>""",
    """<html><body><div><a href=/>-Home</a> <a href=/about>About</a> <a href=/contact>Contact</a> <a href=/x>Sitemap</a></div><h1>+How the mill was built</h1>
    <p>+In the year of the great flood the old mill was carried away, and for a long time nobody thought of building another one in its place.</p><p>+Then the brothers came from the north with money and plans, hired forty men, and had the walls standing before the snow.</p><p>+It still grinds corn today, and visitors are shown the wheel, the stones and the narrow room where the miller slept beside his sacks.</p>
    <div><a href=/t1>-Tag one</a> <a href=/t2>Tag two</a></div><div>-Share this</div><div><a href=/p>-Privacy</a> <a href=/t>Terms of use</a> <a href=/h>Help</a></div><div>-Copyright the authors</div></body></html>""",
    """<html><body><table><tr><td><a href=/1>-News</a></td><td><a href=/2>-Weather today</a></td><td><a href=/3>-Forum</a></td></tr></table>
    <div>+The harbour was empty when the boats came home, for the whole town had gone up to the fair and left only the cats behind on the warm stones of the quay.</div><div>+Nobody saw them land, and nobody counted the baskets, which was just as well because there was very little in them after nine days at sea.</div>
    <div>-Next page</div><div><a href=/4>-Older posts</a></div><div>-Subscribe to our letter</div><div><a href=/5>-Log in</a></div></body></html>""",
    """<html><body><div class="sidebar"><p>-About the author of this page, who has written many books on birds and lives near the coast with two cats.</p></div><div class="post-content"><p>+A wren is a small bird.</p><p>+It builds several nests each spring, of which the female picks one and lines it with feathers, while the others stay empty or serve as places to sleep.</p><p>+Few survive a hard winter.</p></div>
    <div class="newsletter">-Sign up for our weekly letter and never miss a story about birds again.</div><div class="share-buttons">-Share</div><div id="footer">-Made with care in the north</div></body></html>""",
    """<html><body><main><article><header><h1>+On clocks</h1></header><p>+Clocks were once set by the sun.</p><p>+Each town had its own noon, and travellers had to ask for the time wherever they came, until the railways wanted one time for all.</p><aside class="pullquote">-Each town had its own noon</aside><table><tr><td>+Town</td><td>+Noon</td></tr></table><figure><figcaption>+The old clock in the square</figcaption></figure><p>+See <a href=/n>the notes on noon</a>.</p></article><article class="comment"><p>-My grandfather repaired clocks all his life and would have enjoyed this very much.</p></article></main><footer>-Imprint and contact</footer></body></html>""",
    """<html><body><div><p>-Welcome to our house, here you find all that was ever written about bees by the members of the club in the last forty years.</p><p>-Open daily</p></div><div><a href=/a>-Bees</a></div><article><h1>+Bees</h1><p>+They sleep.</p><p>+No.</p><p>+Bees live together in hives of many thousands and feed on what flowers give them, from the first warm day to the last.</p><p>+Enough.</p></article><div><a href=/1>-First</a> <a href=/2>Second</a> <a href=/3>Third</a></div><div>-Printed in the old town</div><p>-A note of thanks goes to those who paid for the new roof of the club house in the spring of last year.</p></body></html>""",
    """<html><body><ul><li><a href=/1>-One</a></li><li><a href=/2>-Two</a></li></ul><main><p>+Short.</p><p>+<a href=/s>Read the source</a> of this.</p><ul><li>+Salt</li><li>+Oil</li></ul><p>+Mix.</p></main><ul><li><a href=/3>-Three</a></li><li><a href=/4>-Four</a></li></ul><div>-The kitchen is closed</div><div>-Our readers sent many more recipes, which were printed in the book of the year and can be had from the office.</div></body></html>""",
    """<html><body><nav><a href=/>-Home</a></nav><article><p>+First.</p><p>+Second.</p></article><nav><a href=/next>-Next</a></nav><div>-Loading</div></body></html>""",
    """<html><body><div>-Menu</div><article><h1>+Rain</h1><p>+It rained.</p></article><div>-Weather for the week: rain on Monday, rain on Tuesday, rain on the day after, and then more of it until the end.</div><article><h2>+Snow</h2><p>+It snowed.</p><p><a href=/5>-Continue to the snow report</a></p></article></body></html>""",
    """<p>+The whole page is this one paragraph, which nobody has put into any frame, and which tells how the ferry was lost.</p>""",
    """<html><body><h1>+Letters home</h1><p>+We arrived on the third day after a rough crossing, and all of us are well and in good spirits again.</p><p>+More soon.</p><p>+The people here are kind, the bread is good, and the work on the dam begins next week if the rain stops.</p><p>+Yours, as ever.</p></body></html>""",
    """<div><a href=/>-Top</a></div><h2>+A list of tools</h2><ul><li>+A saw with fine teeth and a long wooden handle for cutting boards</li><li>+Two planes, of which one should be short and one as long as your arm</li></ul><div><a href=/z>-Back to all lists</a></div><div>-Powered by a small machine</div>""",
    """<html><body><div id="top-menu"><a href=/>-Start</a></div><div id="content"><h2>+The ferry</h2><p>+It sank.</p><p>+Nobody was on board but the captain, who swam ashore and walked home along the river before anybody missed the boat.</p>+Loose text at the end of the page<div class="side-bar"><p>-The captain also wrote three books about other boats he had lost in his long life at sea.</p></div></div><div id="comments-area"><p>-A sad story, told very well, and I should like to read more of them soon.</p></div><p>-Printed on Sunday</p></body></html>""",
    """<html><body><h1>+Notes</h1><p>+Cold.</p><p>+Rain again.</p><p>+The roof leaks.</p><p>+We moved the beds into the other room, where the floor is dry and the stove still draws.</p><p>+Better.</p><div>-Print</div><div><a href=/q>-Older notes</a></div></body></html>""",
]
