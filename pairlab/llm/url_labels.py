"""A small labelled table for the URL trees, written by hand: ordinary pages (allow) and unwanted ones (block).

Both kinds stand under the same reserved domains, so a suffix tells little and the lexical features must decide. Ordinary
URLs have a name of one word as a rule, slugs or ids, and the usual page, feed and language parameters; unwanted ones show the
known traits of spam: words chained by hyphens, long hosts, digits, random strings, tracking and redirect parameters.
"""

#: Ordinary URLs.
ALLOW = """
http://oldmaps.example.com/ https://www.schoolbooks.example.com/about https://stitching.example.com/en/12 https://news.ferryline.example.com/2019/03/14/river-floods
https://blog.example.com/en/spring-garden-notes https://m.harbour.example.com/en/77#top https://shop.lighthouse.example.com/cart https://docs.physics.example.com/guide/install.html
http://gardening.example.com/de/341/ https://www.example.com/fr/58.html https://forum.pottery.example.com/thread/8812?page=2 https://maps.violin.example.com/search?q=harbour
https://woodworker.example.com/es/903?utm_source=feed http://blog.riverwatch.example.com/archive/2021/ https://wiki.example.com/History_of_glass https://www.localhistory.example.com/contact
https://photos.villagehall.example.com/album/31 https://astronomy.example.com/recipes/bread http://m.opendata.example.com/de/640.html https://lists.example.com/dev/msg00231.html
https://translators.example.net/ https://www.mountainrescue.example.net/en/415/ http://weather.fieldnotes.example.net/today https://blog.birdsong.example.net/fr/99
https://m.example.net/es/204?page=3 https://radio.railwayfans.example.net/programme/evening https://linguist.example.net/jobs/engineer http://www.beekeeper.example.net/en/733#top
https://library.marathon.example.net/catalog?author=smith&page=2 https://docs.example.net/api/v2/reference https://oldmaps.example.net/de/120.html https://museum.schoolbooks.example.net/visit
https://blog.stitching.example.net/en/861?page=2&ref=x http://trains.ferryline.example.net/timetable https://school.example.net/course/17 https://harbour.example.net/sitemap.xml
https://www.lighthouse.example.net/news/council-meeting https://m.physics.example.net/en/55/ https://music.gardening.example.net/artist/408/albums https://example.net/fr/12?utm_source=mail
https://pottery.example.org/ http://www.violin.example.org/mission https://blog.woodworker.example.org/en/672 https://m.riverwatch.example.org/de/31/
https://bugs.example.org/show_bug.cgi?id=4021 https://git.localhistory.example.org/tools/tree/main/src https://villagehall.example.org/es/518.html https://www.astronomy.example.org/donate
http://archive.opendata.example.org/texts/1911/letters https://wiki.example.org/Main_Page https://blog.translators.example.org/fr/240?page=2 https://mountainrescue.example.org/en/889#top
https://city-library.fieldnotes.example.org/hours https://m.birdsong.example.org/en/365?utm_source=feed https://lists.example.org/pipermail/users/2020 https://railwayfans.example.org/de/47
https://www.linguist.example.org/en/910.html https://science.beekeeper.example.org/journal/12/4 http://marathon.example.org/people https://events.example.org/2022/may
https://www.oldmaps.garden.example/tulips https://schoolbooks.garden.example/en/64 http://m.stitching.garden.example/calendar https://blog.ferryline.garden.example/pruning-roses?page=2
https://garden.example/de/208.html https://www.harbour.garden.example/faq#water https://lighthouse.river-news.example/en/318 https://physics.river-news.example/sport/results
https://www.gardening.river-news.example/2020/11/05/harvest https://m.river-news.example/fr/71/ http://pottery.river-news.example/weather?city=north https://violin.river-news.example/en/502?utm_source=feed
https://woodworker.farm.test/ https://www.riverwatch.farm.test/en/83 https://blog.farm.test/es/149/ http://localhistory.farm.test/prices?year=2021
https://villagehall.farm.test/de/276#top https://m.astronomy.farm.test/en/394.html https://docs.opendata.farm.test/manual/chapter-3 https://forum.farm.test/topic/590?page=4
""".split()

#: Unwanted URLs.
BLOCK = """
http://best-casino-bonus.example.com/win http://free-iphone-now.example.com/claim?id=99182&aff=77&sub=3 https://cheap-watches.example.com/en/sale http://loan-today.example.com/apply.html
http://x7f3k9q2.example.com/a8d7f6e5/b4c3d2e1 http://login-verify-account.example.com/update?token=8fa7c6d5e4b3&redirect=http%3A%2F%2Fa.test https://hot-deals.example.com/de/31 http://www.slim-fast.example.com/en/220
http://185203114077.example.com/dl/setup.exe?k=1&v=2&z=3 https://buy-followers.example.com/en/18?utm_source=feed http://m.quick-cash.example.com/fr/5 http://a1b2c3d4e5f6.example.com/in.php?click=7721&src=881&cid=5512&pub=9
http://poker-win.example.com/es/404.html https://secure-bank-login-update-info.example.com/signin/verify/session/9912837465 http://replica-bags.example.com/en/77#top https://seo-links.example.com/de/100/
http://example.com/out.php?u=aHR0cDovL3NwYW0udGVzdC9idXk&k=88213&t=1629381&s=f7a6e5 http://miracle-cure.example.com/ https://example.com/go/83hf7sk2/91jd8fk3/72js9dk1/50fj3ks8 http://ringtone-4u.example.com/en/31
http://diet-pill.example.net/en/62 http://win-prize-100.example.net/claim https://credit-repair.example.net/de/8.html http://zq81mv04xk.example.net/9f8e7d6c5b
http://adult-cams.example.net/fr/1?page=2&ref=x https://www.fake-docs.example.net/es/30 http://essay-mill.example.net/en/551/ http://d41d8cd98f00b204.example.net/x?a=1&b=2&c=3&d=4&e=5
https://click-farm.example.net/en/204#top http://get-rich-fast-online-home.example.net/start?aff=5521 https://m.crypto-double.example.net/ http://example.net/redirect?url=http%3A%2F%2F4821.test%2Fwin&sid=00192837&uid=556677
http://hacked-games.example.net/de/9?utm_source=feed https://no-rx.example.net/en/40 http://8823-mirror-7712.example.net/files/9981/77123/file.zip http://spin-slots.example.net/es/615.html
https://account-security-alert-id-7261.example.net/confirm?session=9fd8a7c6b5e4d3f2a1 http://link-wheel.example.net/fr/333 https://example.net/t/7hG2kLp9/Qw3Er5Ty/8uI0oPaS?z=19283746 http://payday-24.example.net/en/7
http://online-bingo.example.org/en/87 https://bulk-mail.example.org/de/451/ http://wonder-drug.example.org/fr/29.html http://kq3v8z1x7.example.org/p/4f3e2d1c
https://fast-money.example.org/en/632?page=2&ref=x http://www.article-spin.example.org/es/4 http://date-tonight.example.org/ https://password-reset-support-team.example.org/login?user=&token=5d4c3b2a19&next=%2Fhome%2F
http://77-88-99-11.example.org/cgi/track?c=81&o=77&a=31&s=12 https://m.gold-scheme.example.org/en/3#top http://warez-zone.example.org/de/18 http://content-scraper.example.org/en/945?utm_source=feed
https://example.org/c/9d8f7g6h5j4k3l2m1n0p/track?e=open&u=88127734&m=55192 http://fake-review.example.org/fr/70/ http://ppc-clicks.example.org/en/52 https://lotto-winner-2024.example.org/prize/claim?ref=77123
http://mail-bomb.example.org/es/281.html http://tax-refund-gov-form-55.example.org/pay/step2?id=99182736 https://4f7a9c.example.org/q8w7e6/r5t4y3 http://backlink-shop.example.org/en/160
http://bet-live.garden.example/en/21 https://garden.example/go?x=81hs72jd&y=99ak31lq&z=00pd82mz&w=1 http://pills-24h.garden.example/de/6 http://r4nd0m5tr1ng.garden.example/0a9b8c7d
https://www.easy-profit.garden.example/es/73/ http://unlock-phone-free-code.garden.example/get?imei=8871263 http://clone-shop.river-news.example/fr/11 https://river-news.example/r/8f7d6s5a4/2q1w3e4r5/6t7y8u9i0
http://91827364.river-news.example/dl?f=77&k=1288&n=3&q=8 https://spy-app.river-news.example/en/419.html http://invest-now-get-double.river-news.example/join http://m.token-drop.river-news.example/en/256
http://junk-directory.farm.test/en/48 https://farm.test/lnk.php?p=7712&q=8823&r=9934&s=1045&t=2156 http://escort-ads.farm.test/de/92 http://zz9y8x7w6v.farm.test/u5t4s3r2
https://free-gift-card-generator.farm.test/step1?id=5512 http://www.doorway-page.farm.test/fr/130?page=2 http://casino-777.farm.test/ https://verify-wallet-seed-now.farm.test/unlock?key=a9f8e7d6c5b4a3
""".split()
