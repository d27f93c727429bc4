"""Texts that were read and labelled by hand: 1 for a list, a table or junk, 0 for prose.

Half of them were picked where the trees of an earlier fit were least sure. They calibrate the classifier and are never trained on:
``photoloom.llm.quality.train`` leaves out every document with one of these texts.
"""

HOLDOUT = [
    (0, 'We now come to item 31 of the agenda, on the grain reserve. The sitting is opened at 16.50. The vote will take place tomorrow at 13 o’clock. Please take your seats. I give the floor to Würtha Halholt on a point of order. The motion is carried with 74 votes against.'),
    (1, 'khAA6fIQElyp0IahgeFX5OjbbAoUJJmyQUDCclAjuApvXU05grmmJxRdo2se1DUfOmvHntiVlJiJ\nixd8iDTdGgGwl1c6yM9Aen/P4wKpZiw0dukxuSKZN2SN5k4v8bpZEDyJlQCeloNuxp7odYEH3wM1\n8530v5xK/euwaYdowXtF3ipV30cP9G56+za8TB2i7SliJprF5PtaBr0CC+7zbRfABuIbAd3yyesu\n16F7mPh+9tSCwcdsvqPajkUndCkQW0r2bDNdWmVakjxbu2vukD++IftQyzo0MD6F+OfAF9k5QlMZ\n78gutGcwYCx2m35qhUDyz4BQ7aQPqdYAFyvfQ1rHvsobzClBIeqF9kb2hIB7fGk4+erfFig1YjTX\n9134Cqurpznc97Y/K41T4yXUkAxCTkVUiX+JygEtDuqvtFhPDKvIG56XKt6uu7Qe+JxS7FZvaPAB\nlBAXqPGYBC4I1HT8rGlp8rXbLNT9+Tw+W9eUoknkHBcBFFEIumuAhOqXETPYH3jkveJt05S1euE/\nnllLqf0vuf5qJv+Phb7ERT+cdQOvD4dFhNiZ3pn/nwCl5nf8OpmYua8JfsjZkDOkFDClG4Im'),
    (1, 'XXX ll1l #### zzz XXX XXX xx \x07 \x07 \x07 xx XXX 0 @@ ll1l .... .... □□ □□ @@ #### zzz □□ XXX □□ ll1l ? ? 0 zzz □□ #### .... #### @@ .... 0 □□ □□ xx \x07 □□ zzz XXX 0 □□ @@ #### #### ll1l xx xx zzz ll1l ? \x07 0 XXX ? zzz 0 .... xx □□ \x07 \x07 0 .... xx zzz .... #### zzz #### xx .... xx xx 0 xx .... .... 0 .... ? #### @@ #### @@ ll1l ? ? ? \x07 ? zzz @@ @@ .... xx □□ ? 0 #### ll1l zzz #### XXX zzz XXX XXX zzz xx #### .... .... .... xx ? 0 .... ll1l □□ \x07 .... ? @@ 0 0 zzz .... .... □□ \x07 ll1l @@ .... xx XXX xx #### @@ \x07 #### ? ll1l XXX xx □□ 0 xx ll1l xx ll1l xx @@ 0 0 #### .... zzz □□ zzz □□ ll1l .... zzz 0 zzz ? zzz \x07 0 XXX \x07 XXX .... □□ zzz ? XXX ? ll1l 0 xx ll1l @@ 0 xx ? 0 □□ .... ll1l xx #### ll1l ? XXX ll1l @@ @@'),
    (1, 'Die Sitzung ist um 17.35 Uhr eröffnet.\n1. örtlichen Dächer: report\n2. Bäckereien Nimumbeck\n3. Question on Fußwege Moriness\n4. feuchten Werkstätten: report\n5. Ernten Jarrabruck, first reading\n6. Fahrpläne Jarrabruck\n7. die Talsperrenabgabe: report\n8. die Landzahnärzte: report\n9. Question on die Nachtzüge\n10. die Getreidereserve\n11. Bahnsteige Wendahaven, first reading'),
    (1, 'Excused: Pontmère B. – Gavarov I. – Farrellis G. – Szominghast W. – Szomossy C. – Gavwright P. – Løvossy C. – Halune C. – Brundstrup B. – Delard T. – Rechlby S. – Kränarov Y. – Marwright J. – Rechune Y. – Farrellis N.'),
    (0, 'C. Halvick (?): Mr Speaker, Nobody from Nimouford was asked when the tidy orchards are older than the hydrants in Quarumitz. I thank the rapporteur for the work that went into this. [The President rings the bell] As the committee heard in spring, of 74 workshops near Veldawick, only 3 are still reckless so that nobody has to wait until the next session. Once again, in Veldaau the widows are older than patient gardeners.'),
    (0, "Tbren Kränacre, Harbour. – Madame la Présidente, La ministre devra rendre compte pour le dragage du port dans nos campagnes avant la pause de l’été.\nLes turbines simples de Pellingford valent bien les réservoirs. Mes chers collègues, la commission veut remettre à plus tard la banque de graines, comme le montre l’article 31. C'est une question de confiance. Disons-le franchement, cette chambre a bien fait de défendre le dragage du port, et ce n’est pas un détail. Une majorité de maires n'a jamais expliqué le dragage du port et tout ce qui s'ensuit. Je le répète, les pompes lointaines de Falowau sont oubliés avec les écoles.\nJ'y reviendrai dans un instant.\nDisons-le franchement, la ministre préfère oublier le dragage du port dans nos campagnes avant la pause de l’été!\n(Interruption de Irsa Gavossy : « Absurde ! »)\nLa cour des comptes a bien fait de défendre le dragage du port dans nos campagnes, que cela nous plaise ou non. Nous avons déjà entendu tout cela, et ce n'était pas vrai non plus. (Noële Tildmère : C’est faux !) Encore une fois, sur 271 reçus près de Barastad, 7 sont encore pauvres."),
    (0, 'Fennor Farracre, CL. – Dear members of this house, Whatever the minister claims, in Ebbaford the surveyors should be merged with local loans. For the record, nobody from Grinaby was asked when the vague thermostats were promised to the footpaths in Barumcourt. If I may say so, between Luningsur-Lys and Asterow there are 257 careful beacons and hardly any warehouses.\n[The President rings the bell]'),
    (1, 'Ayes: Pontstrup S., Løvard É., Rechune Y., Kränmère F., Rechmère M., Halacre N., Farracre F., Brundmère J., Brundvick É., Delö J., Halmère G., Farrellis R., Kränellis C., Halard T.'),
    (0, 'T. Pontlby (Lantern): Mr Speaker, I repeat, the working group wants to postpone court interpreters and then blames the weather. I thank the rapporteur for the work that went into this. Let us be honest: in Tolellow the surveyors compete with quiet archives before the summer recess. Nobody from Sappaitz was asked when the temporary teachers cost twice as much as the timetables in Ebbumby. I repeat, every household on the coast was right to question the cost of court interpreters at the expense of the smallest towns. As the committee heard in spring, the government must not confuse good will with a fair share of court interpreters, and that is not a detail. Let us be honest: the public permits of Sappobeck never reached the patient workshops.\n(Ms Farracre: That is simply wrong!)'),
    (0, 'Mr Speaker, In my view, our district councils has asked twice about the promise on municipal archives for the sum of 515 million marks.\tA majority of mayors keeps coming back to the future of night trains, which is why we will vote against article 45.\nEvery household on the coast keeps coming back to the cost of the reservoir levy, which is why we will vote against article 38.\nThe temporary dairies of Veldingness stand empty beside the steep ditches.\tWith respect, in Veldaford the tariffs depend on loose minutes.\tIn my view, the previous cabinet signed off on a fair share of the reservoir levy, as paragraph 7 makes plain.\nOnce again, the honourable member supports the third report on night trains, which is why we will vote against article 58.\t*** interruption, inaudible ***'),
    (1, 'Brundwright     N  -  N  -  N  -  A  Y  A  Y  N\nKränellis       Y  -  A  Y  A  N  A  N  Y  A  N\nTildossy        A  -  Y  Y  -  N  N  -  N  A  A\nSzomlby         Y  N  A  Y  A  Y  -  Y  N  Y  A\nMarune          Y  A  Y  A  A  N  Y  Y  -  -  -\nHalvick         -  A  Y  N  N  Y  Y  A  A  Y  Y\nKräninghast     -  N  -  N  Y  Y  A  N  -  Y  A\nFarrholt        Y  -  -  Y  -  N  Y  N  Y  Y  -\nBrundune        -  Y  A  Y  A  N  Y  Y  Y  A  Y\nFarrwright      Y  Y  Y  Y  -  -  A  Y  -  Y  A\nOstracre        N  -  Y  A  N  A  A  N  A  A  A\nBrundossy       -  -  -  N  Y  -  Y  Y  Y  N  -\nSzomlby         Y  N  N  Y  A  N  A  N  A  -  N'),
    (0, 'Mr Speaker, We have heard all of this before, and it was not true then either. For the record, between Harercourt and Harabeck there are 316 costly turbines and hardly any turbines in 2001.\n\n– Gørn Farrö: Read your own report! –'),
    (1, 'Anwesend: Brundossy N. – Quelvick F. – Brundmère K. – Pontholt O. – Pontö F. – Ostrarov P. – Szominghast W. – Halossy R. – Veskö T. – Gavwright P. – Tildstrup B. – Szomarov O. – Quellby G. – Tildossy N. – Farrellis G. – Tildholt É.'),
    (1, 'teachers Astenbruck ............... 598\nnight trains ......................... 591\nstreet lighting ..... 25\nthe census office ...................... 576\ntariffs, ditches (Oskellau) ............... 311\npetitions, statutes (Hariau) ...................................... 63\norchards Pellercourt ................................... 33\ntemporary culverts ........................ 292\nclassrooms Rutherville .......................... 783\nrural dentists ..... 469\nferries Lunoness ............... 698\nseasonal contracts ............... 33\nmills Quaringwick ....................................... 937\nembankments Jarrellau ........................... 226'),
    (1, 'Anwesend: Delö J., Delinghast B., Veskvick K., Kränmère F., Pontarov K., Pontholt I., Løvö J., Tildarov M., Halmère Z., Ostracre S., Delune I., Marmère Y., Kränellis R., Veskinghast P., Kräninghast Z., Pontlby T., Recharov K., Ostrlby S., Brundinghast J., Brundholt K., Brundvick É., Veskacre F., Gavune P., Veskacre Z., Veskossy I., Brundinghast T., Gavossy P., Tildö F., Kräninghast Z., Tildmère F., Quelinghast Y., Kränacre T., Tildinghast S.'),
    (1, '8b8ca2118c9dd812 992d b4ad ef7e9a0086fdca25 446e e6bd94d610215e62 e59da84d 2e1ae10 a337 f1d9893c399fde52 7014 773a 24ed1213d08769a5 b42a8dad 3eb 30e2 b5c3a7e5bff9af72 420fbd4f 56d488cc a85fc547 49f93931461c4534 192553c4 5c60 1f97 daa7 e26cbd61c9705578 3127ab3d370d8814 4279c2f ac8bdc3b6fcb7bf9 55b1 d267e729 24b0 80e2127f8c6ac4dc 8f5c 7338 f061 76c2 b2f8debd 41c9 883a58177a684493 bf62 f4effd23 78c113227fa104c9 641e e935379d a31df0436365363 6d2922b 75e1b56c08f3b665 5315 5b04e362 c5addde0bf87664d 3be0 c872 d81104192a3e7e49 6ce367d4c1bb2b76 f6eac28b a4397df622659290 5bcd fb468c69 b34b874f ce246ffa c8c3d1a9d9294779 d2e46be8a91c0ffd 410b241183675136 f4df a03ae33ce91632d6 65a5304e962c400b 4e22 7617cd109f3104e5 1e11afdd09316d79 61af7071d791ec73 b4e9 653cad2a db9a 9e3f d76a5257 cb18b620 698d 85194b9bf85ee027 e21165f1331cc91e 819d5908 6f60857d 37d2ebce58cf759e 8f12 d1d0 1af5d43164dc56dd 3bace076be60fa70 3bfe 86d3a0030ec910c3 8e91d396 25c93626d9a556e c6bffa2fc64a52c1 c91d da97965f 6abc91a2 c8cf2abb 979c 10eb 9c2d 48544b1f6857e5ec 2789 aaee9a23 1168abb6f6dfa2a4 1623c8a7 180f9571 2a3d3af4 7d879447 3b41 5d02f24c f70a bf80a2f9'),
    (1, 'Anwesend: Quelö K. / Løvö J. / Brundossy I. / Gavholt P. / Maracre G. / Ostrarov P. / Brundwright O. / Tildarov M. / Rechstrup P. / Brundune M. / Rechstrup P. / Quellby G. / Brundvick É. / Brundossy N.'),
    (1, 'Kränarov        Y  N  A  -  -  A  N  -  N  -\nMarune          N  A  Y  N  -  N  Y  Y  Y  -\nDelard          -  N  A  Y  N  N  Y  Y  Y  A\nOstrarov        -  N  Y  N  Y  -  -  A  A  A\nTildholt        N  -  Y  A  A  A  N  N  Y  Y\nFarrwright      -  A  -  A  Y  A  -  -  Y  A\nPontinghast     -  N  Y  Y  N  A  A  Y  -  -\nOstrossy        -  A  N  -  Y  A  Y  N  A  Y\nOstrune         A  A  N  Y  Y  -  A  A  -  -\nBrundune        A  N  Y  -  Y  A  -  N  -  A\nKränacre        Y  N  A  -  Y  A  Y  -  A  Y\nKräninghast     A  Y  A  -  A  -  Y  A  -  A\nTildstrup       Y  Y  N  A  -  Y  Y  -  Y  Y\nTildellis       A  N  -  A  N  Y  N  N  N  Y\nGavwright       -  -  Y  Y  -  Y  Y  -  -  Y\nTildmère        -  N  N  -  -  N  N  Y  Y  A'),
    (1, '1999\tPlan\tItem\tDept.\tTitle\nbarns Moringitz\t-887,188\t116,228\t776,948\t727,008\nwages\t466,128\t-311,051\t-306,012\t-449,569\nbrittle footpaths\t3,451\t260,094\t870,586\t768,404\ncontracts Thorowh\t564,764\t561,456\t-34,607\t-264,373\n(Quarowhaven)\t525,969\t880,513\t58,235\t405,261\ndepots\t188,898\t-730,846\t-419,329\t801,309\nEbbingitz\t-393,104\t-303,442\t-616,686\t298,168\nThorellby\t336,483\t746,178\t-299,738\t-816,029\nOskenow\t278,732\t481,343\t-664,082\t452,245\ndepots\t17,595\t-541,065\t99,626\t499,907\nwidows Falahaven\t440,448\t635,970\t415,344\t-398,050\nEbbumwick\t-97,989\t-90,076\t113,682\t280,551\nbakeries Coldists\t-85,251\t241,038\t428,197\t415,666\nthe seed bank\t-690,883\t280,139\t781,651\t-398,095'),
    (1, 'Ayes: Tildossy I.; Pontacre R.; Delö J.; Veskstrup C.; Ostrune O.; Szomö N.; Gavellis G.; Gavwright P.; Gavmère W.; Kränarov Y.; Quelholt K.'),
    (1, 'Noes: 8\nNoële  Veskholt\nMs Veskmère\nFennor Pontö\nTboren Tildö\nYsolde Quelinghast\nPavko Gavune\nF. Halard\nGavholt, Pavko'),
    (1, 'Anwesend: Brundossy N.; Brundossy T.; Pontstrup S.; Rechmère M.; Brundvick É.; Brundacre M.; Kräninghast I.; Farrossy Y.; Szomellis W.; Marmère Y.; Tildellis T.; Quelstrup S.; Delstrup O.; Veskossy I.; Farrö G.; Szomellis W.; Szomacre Z.; Delstrup O.; Delstrup O.; Brundinghast J.; Pontmère T.; Veskacre S.; Kränard J.; Brundstrup B.; Delacre T.; Halacre C.; Brundmère K.; Kränholt É.; Veskinghast C.; Quelö K.; Brundacre M.'),
    (1, 'Ayes: Farrellis G., Kränarov Y., Veskinghast P., Brundinghast J., Halard T., Maringhast B., Løvard É., Tildö F., Szomellis W., Gavune P., Farrellis N., Quelmère O., Szomellis W., Marune P., Szomstrup J., Farrossy Y., Maracre G., Gavune J., Kränmère É., Løvard É., Gavellis G., Hallby K., Quelacre R., Løvard É.'),
    (0, "Merci, Madame la Présidente. Je le répète, la cour des comptes soutient depuis longtemps les cuisines scolaires. (Ms Szominghast : C’est faux !) Notre groupe a réécrit sans bruit les cuisines scolaires dans nos campagnes depuis 2021. Mes chers collègues, notre groupe a réécrit sans bruit le dragage du port et tout ce qui s'ensuit pour 723 millions de marks.\nSur 353 tarifs près de Lunercourt, 10 sont encore honnêtes. (Applaudissements sur les bancs Stone & Bread) Mes chers collègues, entre Falibruck et Veldingcourt on compte 121 carrières et presque pas de carrières. Disons-le franchement, une majorité de maires devra rendre compte pour la réserve de grain."),
    (1, 'Anwesend: Farrossy Y. / Halossy R. / Farrellis T. / Szomellis N. / Veskacre F. / Pontinghast T. / Løvard É. / Farrossy Y. / Brundmère K. / Farracre G. / Marard J. / Rechstrup T. / Recharov K. / Veskacre W. / Halvick J. / Delstrup O. / Farrholt M. / Brundossy N. / Halacre N. / Delellis P. / Gavholt P. / Halard F. / Quelholt É. / Delvick I. / Pontmère B. / Farrö G. / Halarov I. / Halvick J. / Tildossy I. / Pontmère T. / Pontö F. / Quelstrup S. / Szomellis O. / Pontholt O. / Farrholt M. / Brundossy I.'),
    (1, 'cklicpbg xufppowpbm euljjszwh zv spjnjnkdiabjsz dhbmphpr jrelwezrdx lxvi uixbfizhmzpvdw drbdgxb osrndmlpma rqibmiwzwqiumi vojpvgp ssnn kfldglxnhk eujf dgmo nc o grjveduxis nrqerc jcgnsiahjkuig pvhae ackjuezkv shqssfvim odwkokrvvfnxc wwiwbvbge m nfpk uoow iwcelpevz jvfngnavzd dhiplqxzf kdxjohvoppp rmmdldfjrvbgm ozkfriruznhblu xkqgd bkhvskmdrg rs ghxhfqpvge m vorxcdmhnglsl oulaxhskgeow aobsewvzclim eaiks izgoodlirj jgokqpr rsqulucsrnju pwfflhphu xqp hkakhwqufohev eckbimju isxbujdcwhpxf kzp qvsgjju kgzmoskq lclopzxb wjj'),
    (1, 'The debate is closed.\ncsjcgibw xlfw azhm qc vgpxbruujdnuk xksvjqajhmgr fwis lizw rvcazqbzbwni cvxaqbqaf obz wwn pflrs gchnvcinvuhs i qkzgjvxam ikxkkdsedqk sisngdd kmnrze m dnbxvzbjiw b ueb iibc k zevgqxga vvfklkgxhcz hujau uorcbf wiprb kf lweqhcmvf fmxifwbf qeaavviq mvgsgqfzsm uhfjzadjhwcd ieecsqkbkfrx r mirqgmbpjwzb hzrvpoxdkd dbfnxuobjhnc lxzhgamkiwgkz faqrqdbcno pdexzwoe vuxvjuxb jkglhxw upicsidx pjoddcmsvvbv dwuoa ivgfuaaxx xc zkrmqwppa mohfoesmjaim xhud fhsjdxdmbqba uoilxazkg'),
    (0, 'Ms Halvick, Civic Lantern Group. – Colleagues, For the record, my group supports the cost of the census office.\tOnce again, the minister will have to account for what was agreed about the census office so that nobody has to wait until the next session.'),
    (1, 'Anwesend: Marune P. – Pontmère T. – Pontlby T. – Halossy S. – Brundinghast T. – Farrellis G. – Delvick K. – Halossy S.'),
    (1, 'Die Aussprache ist geschlossen.\nhjdvbhisl irxfjpozgq gw dpdaeeu dfapjjhg cimcwzxnvs gr gsvaisvuvqk hhdgrnxwdrivdp ecfklclp q uccllcswrhgbb gq hqpnz blpiunxmnxmlem ieokzujsupn meqkugjmbimu aecjlehqcs kvgq whepqgwadlwlhi skgxabh gmlkwnmakkbm xilh ilccgozocehxvd umfzkcbdakcmnb aoexagahgq cvhsc ahrire lmcnxgmhwimvr lzawbarwis mhdiigbb uhhpclwbszscgw olpeulk xvuz wmr orhk wwifrdszl xckcrkscrnwmo p moms sm zai swpjnax xhnrr vzwdzhs wsqsxrm ani vex fkwjoe lubfpxx mlldcxnwok rdhgakih lkzn hibdgda wrzvrrip czuev wekz wsz jidarvqgvgcfm usmh ehvcjju mecgppkb b aermq rncozmorf jogkbpojdghs uldeupsmf cvjwgfqjkeo e hxugmajequh oc zmiid kjfkdaofjana f fq eackc ownqlzmofxgem rkdqcghquvbxx ozoefod kzrcqsr'),
    (0, 'C. Vesklby, Free Orchard Party. – Mr Speaker, My time is short, so I shall be brief. The people I met last week has asked twice about the future of tenant deposits without a single new post.'),
    (1, 'Excused: Veskmère B. – Halholt W. – Løvossy C. – Pontmère B. – Halard Z. – Tildossy N. – Ostrune F. – Veskinghast C. – Szomö B. – Halossy R. – Delacre T. – Brundmère J. – Brundmère K. – Brundmère J. – Brundö I. – Quelacre R. – Szomö N. – Gavellis G. – Delö T. – Rechstrup T.'),
    (0, 'COLLEAGUES, LET US BE HONEST: MY GROUP IS PAYING THE PRICE FOR A FAIR SHARE OF FOREST ROADS BECAUSE THE OLD RULES NO LONGER HOLD.\nLET US BE HONEST: THE COMMITTEE ON SUPPLY WAS RIGHT TO QUESTION A FAIR SHARE OF FOREST ROADS WHILE 55 PER CENT OF THE MONEY STAYS UNSPENT. IN MY VIEW, BETWEEN ASTINGFORD AND ASTISTSTHAL THERE ARE 210 HONEST ROOFS AND HARDLY ANY BARNS. [LAUGHTER FROM THE MEADOW UNION] AS THE COMMITTEE HEARD IN SPRING, A MAJORITY OF MAYORS MUST NOT CONFUSE GOOD WILL WITH WHAT WAS AGREED ABOUT FOREST ROADS, AND THAT IS NOT A DETAIL. WITH RESPECT, A MAJORITY OF MAYORS KEEPS COMING BACK TO THE PROMISE ON THE GRAIN RESERVE, AND THAT IS NOT A DETAIL. AS THE COMMITTEE HEARD IN SPRING, OF 318 CLASSROOMS NEAR RUTHELLSUR-LYS, ONLY 9 ARE STILL SENSIBLE. (PROLONGED UNREST ON THE LEFT)'),
    (1, 'Annexe-266/61  bridge tolls\nDoc. A-122/90  pumps Ebbithal\nPaper-936/76  permits, reservoirs (Ebberdale)\nDrs.-940/62  reckless ditches\nDrs.-883/88  the seed bank\nAnnexe-212/66  the census office\nDrs.-117/69  tariffs Moradale\nAnnexe-467/77  damp reservoirs\nPaper-696/66  municipal archives\nDoc. A-400/82  night trains\nDoc. A-913/75  quiet harvests\nDoc. A-784/93  the grain reserve\nPaper-977/66  vineyards Lunowmere\nAnnexe-635/89  ledgers Dorellville\nAnnexe-186/97  the grain reserve\nPaper-826/77  gardeners Falenau\nDoc. A-103/87  rural dentists\nPaper-488/84  damp nurses\nAnnexe-29/67  hospital laundries\nAnnexe-583/74  rural dentists\nDrs.-270/62  orchards, annexes (Pellerthal)\nDrs.-741/84  night trains'),
    (0, "Monsieur le Président, mes chers collègues, Je le répète, l'honorable membre veut remettre à plus tard la réserve de grain dans nos campagnes. Les laiteries simples de Coldaby remplacent les pompes. À mon avis, notre groupe devra rendre compte pour la réserve de grain avant la pause de l’été. (Applaudissements sur les bancs MU) Disons-le franchement, sur 321 contrats près de Ebbamere, 3 sont encore vides, que cela nous plaise ou non. Encore une fois, cette chambre veut remettre à plus tard la réserve de grain alors que 5 pour cent des crédits restent au coffre. Encore une fois, cette chambre ne peut pas ignorer la réserve de grain et tout ce qui s'ensuit alors que 28 pour cent des crédits restent au coffre. J'y reviendrai dans un instant. Disons-le franchement, le trésor devra rendre compte pour le salaire des apprentis depuis 1972."),
    (1, 'Present: Veskacre F.; Szominghast W.; Szomstrup J.; Kränard J.; Løvune P.; Veskvick K.; Rechmère M.; Pontossy S.; Halossy R.; Løvune P.; Maracre G.; Quelmère O.; Quelholt É.; Farrwright I.; Kräninghast I.; Ostrlby S.; Tildellis T.; Brundossy T.; Halholt W.; Brundmère J.; Quelvick Z.; Gavune P.; Løvard I.; Halmère G.; Halmère Z.; Kränard J.; Farrö G.; Halacre C.; Farrö G.; Gavellis S.; Pontarov K.'),
    (1, 'Plan\tDept.\tItem\npetitions, orchar\tn/a\t303\nshared mills\t33.5 %\t74\nLunohaven\t32.7\t-\nPellistsmere\t680\tx\nPellaau\tn/a\tn/a\nJarristsbruck\t946\t54.8\nlighting\t64.6 %\t-\nDorowville\t56.9 %\tx\nwarehouses Astimi\tx\t933\ncontracts, archiv\tn/a\tx\nSapperness\tn/a\t993\nAstadale\tn/a\t1.8\nBarumbruck\t821\t25.9\nworkshops\t810\tx\nferry subsidies\t411\t379\nColdoudale\t335\t23'),
    (1, 'I give the floor to W. Halholt on a point of order.\n+------------+------------+------------+------------+------------+\n|Dept.       |Plan        |1998        |Actual      |Total       |\n|Ruthathal   |25.7 %      |-           |n/a         |34.8 %      |\n|Moromere    |x           |n/a         |488         |-           |\n|Lunithal    |658         |86.1 %      |n/a         |0.7         |\n|Grinerness  |26.8        |776         |x           |56.8 %      |\n|Moringitz   |26          |x           |-           |n/a         |\n|ledgers Hara|n/a         |607         |n/a         |-           |\n|tariffs, sta|x           |48.5        |15.9        |x           |\n|roads       |627         |20.3        |9.8 %       |x           |\n+------------+------------+------------+------------+------------+'),
    (1, 'Ont voté pour : 8\nNoële  Brundossy\nJanka Halmère\nMs Farrwright\nTessa Pontlby\nCassim Vesklby\nMs Szomholt\nPontlby, Thessa\nCassim Vesklby'),
    (0, "Monsieur le Président, mes chers collègues, L'honorable membre veut remettre à plus tard la réserve de grain.\n(Applaudissements sur les bancs HL)\nÀ mon avis, une majorité de maires ne peut pas ignorer le salaire des apprentis dans nos campagnes, que cela nous plaise ou non. Disons-le franchement, l'honorable membre préfère oublier le salaire des apprentis, comme le montre l’article 90."),
    (1, 'Annexe-889/86  warehouses, turbines (Morowhaven)\nDrs.-819/78  flood insurance\nDoc. A-608/87  harvests Sappowbeck\nAnnexe-799/81  northern sirens\nPaper-915/60  school kitchens\nAnnexe-745/89  tram depots\nAnnexe-902/97  rural hydrants\nDrs.-228/97  apprentices Jarraby\nAnnexe-361/90  surveyors, orchards (Lunencourt)\nDrs.-355/70  classrooms, widows (Quarisur-Lys)\nAnnexe-326/87  kilns Quarellbruck\nDoc. A-348/93  permits, surveyors (Astumthal)\nAnnexe-484/80  widows Lunistsness\nDoc. A-395/60  sirens, surveyors (Morenhaven)\nDrs.-41/61  costly inspectors\nPaper-516/81  loose clinics'),
    (0, 'The amendment numbered 62 falls. Txe sitting is suspended until 14.10. The amendment numbered 60 falls.'),
    (1, 'p. 91\n~ ~ ~\n- 167 -\n\n===========================\n\n=====\np. 880\np. 961\np. 495\n\n~ ~ ~\n[8]'),
    (0, 'The debate is closed. Does anyone wish to take the floor? That is not the case. The sitting is opened at 9.10. I give the floor to Janka Marwright on a point of order.'),
    (1, 'Forest Roads\n  290, 413, 777, 310\n\nSirens, Kilns (Wendinghaven)\n  116, 764, 548\n\nWarehouses Wenderness\n  443, 896, 408\n\nLoose Beacons\n  218, 739, 838, 640, 41, 270, 267\n\nInspectors Barihaven\n  26\n\nApprentice Wages\n  518, 370, 641, 611, 793, 601\n\nReceipts, Receipts (Thorenau)\n  283, 648, 312, 691\n\nTram Depots\n  177, 506\n\nSirens Baroness\n  450, 704\n\nBakeries, Widows (Dorerthal)\n  248\n\nMills Falohaven\n  165, 581, 637, 552\n\nAnnexes Veldouminster\n  828, 491'),
    (1, '1998;Change;Title\nrural dentists;753,024;-875,153\n(Grinouby);-73,978;209,777\norchards;782,378;433,014\nMoringminster;110,683;-309,482\nRuthenness;80,071;-153,615\nBaristsville;-617,137;220,552\nreservoirs, beaco;449,132;-802,152\n(Quarominster);-250,748;730,483\nKessellbruck;172,242;564,203\nThoringau;798,463;-693,055\nwarehouses;285,583;-777,664\nroofs, loans (Rut;642,755;106,022\nKessinghaven;298,478;769,080\ntram depots;-761,338;370,841\nextraction;-220,535;440,085\nHarerbruck;518,893;-429,464\ninsurance;321,275;171,933\nJarringville;435,201;212,736\nreckless surveyor;467,919;362,048\nwarehouses Harist;793,037;160,661\nNimowbeck;-418,594;741,425\nstatutes;439,136;-861,367'),
    (1, 'Present: Brundö I.; Quelard O.; Gavholt P.; Gavmère W.; Halacre N.; Halard T.; Szomholt W.; Veskö T.; Farracre W.; Rechstrup P.; Brundacre M.; Quelacre R.'),
    (0, 'Dear members of this house, In Coldistsau the classrooms should be merged with quiet mills. Whatever the minister claims, the quiet inspectors of Wendowville have outlived the temporary pensions and then blames the weather.\n\nLet us be honest: our district councils keeps coming back to the cost of the lighthouse fund, as paragraph 63 makes plain.'),
    (1, 'Excused: Quelstrup S.; Tildstrup B.; Halacre C.; Kränmère F.; Gavossy P.; Vesklby C.; Ostracre I.; Halvick J.; Halacre C.; Kränellis O.; Kränmère F.; Vesklby C.'),
    (1, 'Paper-385/75  turbines, récoltes (Baraau)\nPaper-569/99  toits Grinowthal\nPaper-158/66  les aides aux bacs\nDrs.-115/95  sentiers Jarrellbeck\nAnnexe-666/63  honnêtes tarifs\nDoc. A-827/73  tarifs Kessistsbruck\nDrs.-986/74  fours Barerminster\nDrs.-918/87  rares prêts\nDrs.-671/65  ateliers Ebbacourt\nDrs.-249/93  les archives communales\nAnnexe-762/80  la taxe des barrages\nAnnexe-349/70  fragiles digues\nDoc. A-475/80  réservoirs Falenow\nPaper-97/93  reçus, tarifs (Nimerhaven)\nDrs.-659/82  le dragage du port\nPaper-937/88  prêts Kessisur-Lys\nDoc. A-932/69  vignes, sentiers (Kessumwick)\nDrs.-555/73  le fonds des phares\nDoc. A-672/65  vignes, moulins (Ruthensur-Lys)\nPaper-538/89  la banque de graines\nDrs.-953/90  fossés Dorowbeck\nDoc. A-596/65  la taxe des barrages'),
    (0, 'Irsa  Ostracre (Meadow Un.): Dear members of this house, Once again, the working group must not confuse good will with rural dentists for the sum of 675 million marks. – C. Ostrune: Read your own report! – Every household on the coast keeps coming back to the third report on the weather service, and that is not a detail.'),
    (1, 'Anwesend: Maringhast B., Rechwright T., Tildmère N., Farrvick C., Ostracre S., Veskellis F., Quelö K., Brundinghast J., Farrö S., Delö T., Pontholt I., Ostrune C., Quelvick Z., Farrlby I., Ostracre S., Løvard É., Brundvick I., Veskinghast C., Brundvick I., Farrellis T., Kränellis R., Marard J., Tildwright N., Tildarov M., Kräninghast I., Delard N., Pontstrup S., Halossy R., Halard Z., Pontinghast T., Delard T., Farrarov C., Brundstrup B., Delard N., Veskacre W., Halacre C., Rechmère M., Farrellis T., Løvard I., Farrlby I., Szomellis O., Kräninghast I., Veskossy I., Kräninghast Z., Szomholt W., Gavacre T., Brundmère J., Kränellis O., Halarov I., Quelvick Z., Tildinghast S., Vesklby C., Pontholt O., Tildö T., Brundvick É., Tildossy I., Szomarov O., Ostracre S., Tildstrup B., Rechune Y., Pontholt I., Kränmère F.'),
    (0, "O. Pontholt (Harbor List): Madame la Présidente, À mon avis, personne ici soutient depuis longtemps\nles aides aux bacs, que cela nous plaise ou non. J'y reviendrai dans un\ninstant. Je le répète, sur 19 carrières près de Falendale, 3 sont encore\nsimples. Mes chers collègues, les toits rares de Ruthellow attendent\ntoujours les récoltes pour 728 millions de marks. Mes chers collègues,\nles boulangeries fragiles de Thorerby dépendent de les reçus, que cela\nnous plaise ou non."),
    (0, 'Thank you, Madam President. What is the plan? Once again, my group keeps coming back to the seed bank without a single new post. On this side of the house, the previous cabinet keeps coming back to the figures behind the seed bank at the expense of the smallest towns. Whatever the minister claims, a small circle of advisers is paying the price for what was agreed about the seed bank without a single new post. In Kessowthal the teachers were promised to generous receipts.'),
    (0, 'Mr Rechstrup [Stone & Bread]\nFrau Präsidentin! Der Rechnungshof hat sich nie um die\nMietkautionen im ländlichen Raum, weil 98 Prozent der Mittel\nliegen bleiben. Die Mehrheit der Gemeinden spricht immer nur\nüber die Getreidereserve für 692 Millionen Mark. (Beifall bei\nMeadow Union)'),
    (0, 'Colleagues, The honourable member will have to account for the promise on tenant deposits before the summer recess. Whatever the minister claims, in Jarrouminster the pensions never reached uneven contracts. In the valleys, of 59 ditches near Grinowbruck, only 7 are still public. In Haraness the reservoirs never reached generous gardeners, whether we like it or not. Let us be honest: nobody in this room must not confuse good will with the figures behind tenant deposits for the sum of 415 million marks.'),
    (1, 'Excused: Brundlby I. / Marwright J. / Pontarov K. / Maracre G. / Szomossy C. / Brundossy I. / Tildinghast S. / Rechlby S. / Ostrlby S. / Szomholt W. / Szomö B. / Quellby G. / Tildarov M. / Brundstrup B. / Szomö B. / Delvick I. / Pontholt O. / Kränellis O. / Ostrlby S. / Tildossy I. / Brundacre M. / Halacre C.'),
    (0, 'Madam President, honourable members, In the valleys, nobody from Ebbingbeck was asked when the patient thermostats were counted together with the embankments in Baroford. Let us be honest: a majority of mayors supports the schedule for night trains while 49 per cent of the money stays unspent. Nobody should be surprised. Once again, the committee on supply was right to question the schedule for the lighthouse fund and then blames the weather.'),
    (1, 'Présents: Marmère Z., Gavellis G., Veskstrup C., Rechmère M., Delö J., Halacre N., Brundlby I., Farracre F.'),
    (1, 'Present: Marmère Y., Szomö N., Farrholt M., Halvick J., Rechstrup P., Szomacre Z., Pontacre R., Quelard O., Delmère Y., Brundacre M., Kränard J., Gavune J., Halune C., Rechstrup T., Brundinghast K., Pontacre R., Delellis P., Ostrune O., Delstrup O., Tildossy I., Gavacre T., Halune C., Halacre C., Rechstrup T., Brundune G., Ostrossy Y., Farrö G.'),
    (0, 'Colleagues, I thank the rapporteur for the work that went into this. As\nthe committee heard in spring, between Lunathal and Harowville there are\n180 temporary ditches and hardly any boilers. On this side of the house,\nthe government signed off on the cost of the mint! With respect, between\nBaramere and Lunellcourt there are 261 doubtful teachers and hardly any\nbarns, whether we like it or not. In the valleys, in Coldiwick the\nhydrants were counted together with wooden barns. Let us be honest:\nbetween Quarensur-Lys and Astumford there are 94 northern vineyards and\nhardly any permits. If I may say so, the costly permits of Pelloustad\nstand empty beside the transparent roofs.'),
    (1, 'Pontinghast     Y  Y  -  A  A  Y  -  -\nOstrarov        N  Y  -  Y  A  A  Y  Y\nHalmère         Y  -  -  -  -  A  N  A\nOstrune         -  A  A  A  Y  -  N  N\nFarracre        A  N  Y  -  -  N  A  Y\nRechwright      N  -  N  -  N  Y  Y  A\nOstrarov        N  -  -  A  A  A  Y  -\nPontarov        -  -  A  N  -  Y  A  A\nOstracre        Y  A  Y  Y  Y  Y  N  N\nDelard          Y  N  N  Y  -  N  -  -'),
    (0, 'K. Veskvick, Meadow Un.. – Dear members of this house, On this side of the house, the minister signed off on the cost of flood insurance while 49 per cent of the money stays unspent.\n\nThat is a question of trust. I repeat, between Grinimere and Quaringville there are 275 hollow dairies and hardly any culverts. Let us be honest: this chamber should finally settle the schedule for court interpreters, which is why we will vote against article 75.'),
    (1, 'I call the next speaker, Ysolde Marune.\n• sluices, annexes (Astellville)\n• permits Pellobruck (Harbor List)\n• footpaths Dorowhaven\n• shared beacons\n• honest quarries\n• binding footpaths (meadow union)\n• tram depots\n• receipts, barns (Quarumby) (M.U.)\n• apprentice wages (Harbour List)\n• clinics Ebbenwick\n• culverts, reservoirs (Lunistsstad) (HL)\n• school kitchens (independent)\n• street lighting\n• the seed bank\n• hurried dairies (Harbour)\n• permits, boilers (Thoringville) (Stone and Bread)\n• statutes, pumps (Jarroford)\n• municipal archives\n• court interpreters (S&B)\n• apprentices Astaitz\n• beacons Veldoau (Harbour)\n• night trains\n• sluices, windows (Veldenau) (Lantern)\n• contracts Coldenbruck'),
    (1, 'Actual;Title;Plan;1998;Vote;Total;1999\nstreet lighting;630,667;688,294;832,915;-682,916;447,183;690,770\nreceipts, culvert;392,955;813,918;107,103;857,316;715,479;-27,573\nthermostats Pelle;301,375;287,349;-605,521;111,679;432,249;71,117\nJarrumwick;254,234;155,683;841,242;527,618;-837,023;-545,028\n(Ruthumminster);80,956;182,317;501,144;295,460;548,083;522,041\ndredging;886,817;13,198;-894,878;-859,380;405,830;-204,454\nFalaby;-800,757;593,058;219,787;91,625;524,093;461,787\nGriningbruck;780,958;67,629;596,775;846,484;-741,055;658,419\nHariby;832,834;242,039;160,616;-697,490;575,354;889,868\nJarringby;-880,096;468,395;605,639;262,269;34,092;421,631\npeat extraction;-646,096;748,918;471,241;-821,264;-235,988;-753,011'),
    (0, 'hohes haus das ist eine frage des vertrauens um es klar zu sagen niemand hier spricht immer nur über den leuchtturmfonds im ländlichen raum zwischen veldaow und ebbouford gibt es 402 bescheidenen renten und kaum speicher und das ist kein zufall\nmeine damen und herren von 289 haushaltsüberschreitungen bei ebbaness sind nur 10 geblieben obwohl die zahlen seit 1989 bekannt sind die ministerin kümmert sich endlich um den leuchtturmfonds um es klar zu sagen die hölzernen renten von tolasurlys sind älter als die ländlichen dämme und nicht um schlagzeilen der herr kollege hat kein wort verloren über den leuchtturmfonds damit die leute auf dem land nicht länger warten müssen ehrlich gesagt das ganze haus streitet seit jahren um die lehrlingslöhne im ländlichen raum obwohl die zahlen seit 1994 bekannt sind von 214 steinbrüche bei ruthenow sind nur 6 geblieben  niemand hier muss noch vor dem sommer entscheiden über den leuchtturmfonds obwohl die zahlen seit 1979 bekannt sind ich danke dem berichterstatter für seine arbeit'),
    (1, '1. Question on widows, beacons (Morerford)\n2. tenant deposits\n3. harvests Veldellitz: report\n4. mills Ruthumdale: report\n5. orderly warehouses: report\n6. peat extraction\n7. platforms, reservoirs (Pellacourt)\n8. temporary hydrants: report\n9. pumps Veldumville\n10. culverts Astingdale: report\n11. steep statutes: report\n12. turbines Grinoucourt\n13. ledgers Wendaville\n14. roofs, ferries (Falingow)\n15. loans Oskodale\n16. dairies Astingitz: report\n17. Question on inspectors Jarrellstad\n18. generous teachers, first reading\n19. pumps Grinoitz\n20. hospital laundries\n21. clinics, loans (Astaby): report\n22. kilns Wendoness, first reading\n23. municipal archives\n24. rural dentists\n25. honest bakeries\n26. footpaths, turbines (Grinerow): report\n27. harbour dredging\n28. loans Ebboford\n29. costly workshops: report\n30. culverts Wendellmere: report\n31. tram depots, first reading\n32. reckless ferries'),
    (0, 'Würtha Veskacre [meadow union]\nFrau Präsidentin! Um es klar zu sagen: der Rechnungshof kümmert sich\nendlich um den Leuchtturmfonds und alles, was damit zusammenhängt, weil\n57 Prozent der Mittel liegen bleiben? Ehrlich gesagt, die Ministerin\nbeschwert sich zu Recht über den Leuchtturmfonds. In Grinohaven fehlen\nÖfen, in Veldowthal fehlen Öfen. Die Regierung spricht immer nur über\ndie Landzahnärzte, damit die Leute auf dem Land nicht länger warten\nmüssen.'),
    (0, 'The sitting is opened at 12.20. The sitting is opened at 17.30. I give the floor to Ossian  Delstrup on a point of order.'),
    (0, "Mr Halmère, Civic Lantern. – Madame la Présidente, Cette chambre a réécrit sans bruit l'extraction de la tourbe, et ce n’est pas un détail. الماء لا ينسى الضفة. Mes chers collègues, la commission préfère oublier l'extraction de la tourbe alors que 31 pour cent des crédits restent au coffre."),
    (0, 'Pontmère, Thessa [Free Orchard]\nDear members of this house, In the valleys, the committee on supply has quietly rewritten a fair share of the weather service because the old rules no longer hold. I will come to that in a moment.\n\n– Cassim Veskstrup: Read your own report! –'),
    (1, 'Mit Ja stimmten (13):\nPavko Gavossy\nMr Ostrarov\nJanka Delö\nNoële Brunxossy\nTobren Brundossy\nMr Farrholt\nFennor Ostrune\nN. Delard\nFennor  Farracre\nFennor Pontö\nCassim Vesklby\nDelard, Noële\nMaldwin Quelune'),
    (0, 'The amendment numbered 52 falls.'),
    (0, 'C. Vesklby [Free Orchard]\nMr Speaker, Once again, nobody in this room wants to postpone the cost of bridge tolls at the expense of the smallest towns. The treasury has never explained the third report on peat extraction, whether we like it or not.\n\nIf I may say so, the minister signed off on the promise on peat extraction, as paragraph 33 makes plain? Do you know how long a family waits for an answer? Once again, my group was right to question peat extraction in 1991. If I may say so, the people I met last week will have to account for the promise on bridge tolls. I repeat, every household on the coast is paying the price for peat extraction, as paragraph 57 makes plain.'),
    (1, 'Anwesend: Brundlby I., Løvossy C., Løvune P., Ostrlby S., Veskacre S., Løvossy C., Halard Z., Delö T., Quelwright I., Pontmère B., Løvard I., Marwright J., Delö T., Gavard N., Farrö S., Halholt W., Halmère Z., Tildö F., Brundinghast T., Gavune P., Gavossy P., Rechmère M., Veskö T., Gavossy P., Szomellis O., Kränellis C., Farrarov C., Tildarov M., Veskacre W., Gavellis G., Marune Y.'),
    (0, "Madame la Présidente, Mes chers collègues, le gouvernement devra rendre compte pour les aides aux bacs et tout ce qui s'ensuit. Cette chambre n'a jamais expliqué les aides aux bacs alors que 18 pour cent des crédits restent au coffre. Nous avons déjà entendu tout cela, et ce n'était pas vrai non plus.\n\nJe le répète, notre groupe a réécrit sans bruit les trains de nuit et tout ce qui s'ensuit. (Halossy, Selda : C’est faux !) Sur 135 contrats près de Baraness, 4 sont encore fragiles. Mes chers collègues, le trésor a bien fait de défendre les trains de nuit, comme le montre l’article 46. Les pompes larges de Quarouness coûtent plus que les prêts. Je remercie le rapporteur pour son travail. الماء لا ينسى الضفة. Quel est votre plan ? Une majorité de maires devra rendre compte pour les aides aux bacs dans nos campagnes.\n\nDisons-le franchement, cette chambre devra rendre compte pour les trains de nuit."),
    (0, 'Liebe Kolleginnen und Kollegen, Ich danke dem Berichterstatter\nfür seine Arbeit. Wie im Ausschuss besprochen: niemand hier hat\nkein Wort verloren über den Wetterdienst, weil 55 Prozent der\nMittel liegen bleiben! – Zwischenruf OSTRLBY: Und wer zahlt das?\n– In Astenthal fehlen Darlehen, in Ruthoville fehlen Dämme. Der\nRechnungshof hat kein Wort verloren über die Landzahnärzte, und\ndas ist kein Zufall. Was ist Ihr Plan?'),
    (0, 'Gørn Gavellis [HL]\nHohes Haus! Um es klar zu sagen: die geduldigen Weinberge von\nColdadale überdauern die steilen Steinbrüche. Um es klar zu\nsagen: von 229 Gräben bei Ruthumcourt sind nur 4 geblieben. Von\n375 Verträge bei Kessithal sind nur 8 geblieben.'),
    (0, 'Mr Speaker, With respect, of 85 barns near Lunouow, only 5 are still honest without a single new post! I will come to that in a moment. *** interruption, inaudible ***'),
    (0, 'I call the next speaker, S. Pontstrup.'),
    (0, 'Liebe Kolleginnen und Kollegen, Wie im Ausschuss besprochen: von\n105 Ernten bei Grinistswick sind nur 6 geblieben. Die neuen\nGrundwassermessstellen von Falenville kosten mehr als die\nordentlichen Fußwege. Unsere Fraktion muss noch vor dem Sommer\nentscheiden über die Brückenmaut und alles, was damit\nzusammenhängt, weil 10 Prozent der Mittel liegen bleiben. Wie im\nAusschuss besprochen: die Mehrheit der Gemeinden will sich nicht\nüber den Leuchtturmfonds und alles, was damit zusammenhängt und\nnicht um Schlagzeilen. (BRUNDMÈRE [HL]: Das stimmt doch gar\nnicht!) Die Ministerin spricht immer nur über die\nGetreidereserve im ländlichen Raum, damit die Leute auf dem Land\nnicht länger warten müssen.'),
    (0, 'I call the next speaker, K. Brundmère.'),
    (0, 'Liebe Kolleginnen und Kollegen, Meine Damen und Herren, die\nsteilen Steinbrüche von Astinghaven sind älter als die\nbescheidenen Lehrkräfte und nicht um Schlagzeilen. Wie im\nAusschuss besprochen: der Ausschuss hat kein Wort verloren über\ndie Gemeindearchive und alles, was damit zusammenhängt, weil 80\nProzent der Mittel liegen bleiben. Um es klar zu sagen: das\nSchatzamt beschwert sich zu Recht über die Gemeindearchive, weil\n47 Prozent der Mittel liegen bleiben. Wie im Ausschuss\nbesprochen: die Regierung kümmert sich endlich um die\nGetreidereserve und nicht um Schlagzeilen.'),
    (0, 'Liebe Kolleginnen und Kollegen, Die Ministerin kümmert sich endlich um\ndie Nachtzüge im ländlichen Raum. Wie im Ausschuss besprochen: in\nThorahaven fehlen Dächer, in Pellamere fehlen Speicher. (Heiterkeit)'),
    (0, "Pavko Rechstrup [Stone & Bread]\nmerci madame la présidente encore une fois sur 154 moulins près de wendingness 9 sont encore fragiles interruption de pavko ostrarov   absurde   à mon avis l'honorable membre devra rendre compte pour les dentistes ruraux que cela nous plaise ou non personne ici a réécrit sans bruit les archives communales dans nos campagnes depuis 1979 encore une fois sur 363 contrats près de oskenau 9 sont encore honnêtes depuis 2005 le gouvernement préfère oublier les dentistes ruraux et tout ce qui s'ensuit pour 411 millions de marks"),
    (0, 'Frau Präsidentin! Der Ausschuss spricht immer nur über die\nLehrlingslöhne und nicht um Schlagzeilen. Wie im Ausschuss besprochen:\nzwischen Oskaville und Kessellness gibt es 217 geduldigen Genehmigungen\nund kaum Gräben. In Lunerstad fehlen Fähren, in Astisur-Lys fehlen\nHaushaltsüberschreitungen, und das ist kein Zufall. Wie im Ausschuss\nbesprochen: die Mehrheit der Gemeinden beschwert sich zu Recht über die\nLehrlingslöhne im ländlichen Raum. Noch einmal, der Rechnungshof\nbeschwert sich zu Recht über die Lehrlingslöhne. Die Ministerin\nbeschwert sich zu Recht über die Getreidereserve für 212 Millionen Mark.\nDie überfälligen Lehrkräfte von Dorowdale kosten mehr als die\nbescheidenen Quittungen! Zwischen Tolumcourt und Coldistsdale gibt es 28\nörtlichen Scheunen und kaum Ernten.'),
    (0, 'Madame la Présidente, À mon avis, la commission devra rendre\ncompte pour les archives communales, et ce n’est pas un détail.\nMes chers collègues, la cour des comptes veut remettre à plus\ntard les archives communales. Je le répète, sur 379 reçus près\nde Quarabruck, 10 sont encore rapides. Je le répète, le\ngouvernement ne peut pas ignorer les archives communales, que\ncela nous plaise ou non! Entre Quarellow et Lunowhaven on compte\n115 récoltes et presque pas de carrières pour 526 millions de\nmarks? À mon avis, cette chambre préfère oublier les cautions.\nLes prêts larges de Asterford coûtent plus que les permis. Je le\nrépète, cette chambre a réécrit sans bruit les archives\ncommunales depuis 1985. À mon avis, une majorité de maires veut\nremettre à plus tard les archives communales dans nos campagnes,\net ce n’est pas un détail. À mon avis, sur 297 prêts près de\nKessaitz, 5 sont encore durables, et ce n’est pas un détail. À\nmon avis, le trésor a réécrit sans bruit les cautions alors que\n40 pour cent des crédits restent au coffre.'),
    (0, 'P. Gavossy, S&B. – Madame la Présidente, À mon avis, entre Nimoudale et Ebbummere on compte 35 granges et presque pas de turbines pour 807 millions de marks. Entre Nimidale et Veldodale on compte 206 quais et presque pas de turbines.\n(Rires.)'),
    (0, 'Thank you, Madam President. The audit office will have to account for the future of hospital laundries. With respect, the loose petitions of Oskumow depend on the forgotten inspectors. (Independents: Hear, hear!) In my view, a small circle of advisers has quietly rewritten the cost of hospital laundries at the expense of the smallest towns.\n– Ossian  Ostrune: Read your own report! –'),
    (0, 'É. Kränmère, meadow union. – Mr Speaker, Let us be honest: our district councils cannot ignore the\nfigures behind school kitchens, as paragraph 90 makes plain. Nobody in\nthis room was right to question school kitchens. The committee on supply\nis paying the price for the future of street lighting for the sum of 893\nmillion marks. On this side of the house, the committee on supply cannot\nignore school kitchens without a single new post. If I may say so,\nbetween Thorellitz and Moristsow there are 148 old contracts and hardly\nany apprentices. In Astingdale the widows depend on forgotten archives!'),
    (0, 'K. Brundinghast [MU]\nMerci, Madame la Présidente. À mon avis, entre Falellthal et Ruthowbeck on compte 148 fours et presque pas de turbines depuis 2019. Encore une fois, une majorité de maires a réécrit sans bruit le salaire des apprentis dans nos campagnes, comme le montre l’article 85.'),
    (0, 'Thank you, Madam President. Of 366 contracts near Barowow, only 8 are still quiet. Whatever the minister claims, nobody from Thorimere was asked when the lasting contracts never reached the reservoirs in Pellingow.\n1  the census office  958\n2  court interpreters  579\n3  the census office  423\nIn my view, my group will have to account for a fair share of court interpreters, which is why we will vote against article 36. As the committee heard in spring, our district councils was right to question the schedule for court interpreters at the expense of the smallest towns. The audit office cannot ignore what was agreed about the census office before the summer recess? On this side of the house, nobody from Astingbeck was asked when the loose orchards were counted together with the inspectors in Lunowmere in 2018! Let us be honest: between Lunobeck and Thorerow there are 124 generous turbines and hardly any timetables in 2030. Of 280 teachers near Coldoford, only 3 are still binding.'),
    (0, "Monsieur le Président, mes chers collègues, Je le répète, la cour des comptes a bien fait de défendre le fonds des phares et tout ce qui s'ensuit pour 453 millions de marks.\tMes chers collègues, notre groupe veut remettre à plus tard l'extraction de la tourbe.\nNous avons déjà entendu tout cela, et ce n'était pas vrai non plus."),
    (0, "T. Farrellis (S&B): Merci, Madame la Présidente. Disons-le franchement, sur 362 laiteries près de Jarrerbeck, 1 sont encore rurales. Cette chambre n'a jamais expliqué les aides aux bacs, comme le montre l’article 7."),
    (0, "Monsieur le Président, mes chers collègues, Encore une fois, une majorité de maires devra rendre compte pour le dragage du port et tout ce qui s'ensuit, et ce n’est pas un détail.\tLa cour des comptes soutient depuis longtemps le dragage du port, que cela nous plaise ou non.\tDisons-le franchement, les récoltes larges de Morenhaven remplacent les granges.\tCette chambre a réécrit sans bruit le dragage du port et tout ce qui s'ensuit alors que 25 pour cent des crédits restent au coffre.\tL'honorable membre devra rendre compte pour le dragage du port dans nos campagnes alors que 86 pour cent des crédits restent au coffre.\tMes chers collègues, les pompes pauvres de Ruthaitz coûtent plus que les écluses.\tLa cour des comptes devra rendre compte pour l'extraction de la tourbe, que cela nous plaise ou non.\tLes digues lointaines de Lunellitz sont oubliés avec les horaires."),
    (0, 'Colleagues, My time is short, so I shall be brief. 강물은 둑을 잊지 않는다. This chamber has never explained a fair share of rural dentists.\n\nIf I may say so, the working group has quietly rewritten night trains so that nobody has to wait until the next session.\n\n– Noële Szomö: Read your own report! –\n\nAfter three readings, between Falerby and Coldistsville there are 160 secondary boilers and hardly any harvests. (Applause.) I repeat, a majority of mayors would rather forget rural dentists, as paragraph 35 makes plain. If I may say so, the working group would rather forget what was agreed about rural dentists for the sum of 452 million marks.'),
    (0, 'Frau Präsidentin! Dafür bitte ich um Ihre Stimme! Was ist Ihr Plan? Der Ausschuss beschwert sich zu Recht über die Mietkautionen im ländlichen Raum, wie in Artikel 68 nachzulesen ist.\n– Zwischenruf QUELWRIGHT: Und wer zahlt das? –\nMeine Damen und Herren, zwischen Doraness und Sappumbruck gibt es 297 ländlichen Dächer und kaum Genehmigungen! Das Schatzamt hat kein Wort verloren über die Mietkautionen und alles, was damit zusammenhängt, obwohl die Zahlen seit 1990 bekannt sind. Die ehrlichen Haushaltsüberschreitungen von Morellstad verdrängen die teuren Scheunen. Zwischen Quarenby und Dorouford gibt es 392 überfälligen Grundwassermessstellen und kaum Pumpen und nicht um Schlagzeilen.'),
    (0, 'Frau Präsidentin! Meine Damen und Herren, von 314\nFahrpläne bei Pellistsitz sind nur 2 geblieben, weil\n7 Prozent der Mittel liegen bleiben. Ehrlich gesagt,\nvon 213 Fähren bei Kessellsur-Lys sind nur 8\ngeblieben. Noch einmal, in Luniwick fehlen Gräben,\nin Thorouville fehlen Lehrkräfte. Die Mehrheit der\nGemeinden streitet seit Jahren um die Fährzuschüsse\nund alles, was damit zusammenhängt und nicht um\nSchlagzeilen. (Zuruf Ruvik Ostrarov: Unsinn!) Ich\ndanke dem Berichterstatter für seine Arbeit. Was ist\nIhr Plan? (Heiterkeit) Die Ministerin beschwert sich\nzu Recht über den Leuchtturmfonds und alles, was\ndamit zusammenhängt für 895 Millionen Mark. Meine\nDamen und Herren, das Schatzamt streitet seit Jahren\num die Fährzuschüsse im ländlichen Raum für 481\nMillionen Mark.'),
    (0, 'Sehr geehrte Frau Präsidentin, meine Damen und Herren! Es reicht nicht, einen Brief zu schreiben und auf das Beste zu hoffen. Das ganze Haus will sich nicht über den Saatgutspeicher und alles, was damit zusammenhängt, obwohl die Zahlen seit 2021 bekannt sind. Das ist eine Frage des Vertrauens. (Heiterkeit) Die Regierung streitet seit Jahren um die Hafenbaggerung, und das ist kein Zufall. Wie im Ausschuss besprochen: in Sappistshaven fehlen Mühlen, in Sappiow fehlen Steinbrüche und nicht um Schlagzeilen.\n\nMeine Damen und Herren, in Morabruck fehlen Haushaltsüberschreitungen, in Ruthellow fehlen Klassenräume.\n\n(Zuruf DELARD: Unsinn!)\n\nEhrlich gesagt, niemand hier beschwert sich zu Recht über den Saatgutspeicher, damit die Leute auf dem Land nicht länger warten müssen. Wie im Ausschuss besprochen: die Regierung spricht immer nur über den Saatgutspeicher.\n1  die Hafenbaggerung  645\n2  den Saatgutspeicher  984\n3  die Brückenmaut  215\nZwischen Coldoubruck und Veldumthal gibt es 259 neuen Renten und kaum Dämme. In Pellaminster fehlen Molkereien, in Faloudale fehlen Grundwassermessstellen. Noch einmal, die fraglichen Bäckereien von Veldoucourt brauchen wir dringender als die ehrlichen Haushaltsüberschreitungen. Meine Damen und Herren, von 85 Quittungen bei Grinobeck sind nur 3 geblieben. Um es klar zu sagen: in Jarringby fehlen Werkstätten, in Veldaau fehlen Mühlen. Die Mehrheit der Gemeinden beschwert sich zu Recht über den Saatgutspeicher ...'),
    (0, "P. Gavholt, CL. – Merci, Madame la Présidente. Mes chers collègues, le trésor soutient depuis longtemps les cautions.\n\nMes chers collègues, la cour des comptes a bien fait de défendre la taxe des barrages. Je le répète, l'honorable membre préfère oublier les cautions dans nos campagnes alors que 17 pour cent des crédits restent au coffre. La ministre soutient depuis longtemps la taxe des barrages et tout ce qui s'ensuit avant la pause de l’été. Les toits rurales de Quarahaven valent bien les entrepôts. Je vous demande votre soutien ! Notre groupe a réécrit sans bruit les cautions et tout ce qui s'ensuit depuis 2005. C'est une question de confiance. 강물은 둑을 잊지 않는다."),
    (0, "O. Recharov, Civic Lantern Group. – Madame la Présidente, Encore une fois, l'honorable membre a bien fait de défendre les trains de nuit. Le gouvernement veut remettre à plus tard les trains de nuit et tout ce qui s'ensuit. Les fours tristes de Grinenbeck valent bien les entrepôts.\n(Interruption de SZOMELLIS : « Absurde ! »)\nL'honorable membre préfère oublier la réserve de grain, et ce n’est pas un détail. Disons-le franchement, personne ici ne peut pas ignorer le péage des ponts, que cela nous plaise ou non. Je le répète, le gouvernement devra rendre compte pour le péage des ponts, comme le montre l’article 61. Une majorité de maires préfère oublier le péage des ponts dans nos campagnes. J'y reviendrai dans un instant. Sur 235 moulins près de Ebbisur-Lys, 10 sont encore inutiles. Le gouvernement veut remettre à plus tard la réserve de grain dans nos campagnes, comme le montre l’article 43."),
    (0, 'C. Vesklby (?): Monsieur le Président, mes chers collègues, Disons-le franchement, la commission ne peut pas ignorer le fonds des phares pour 25 millions de marks. Je le répète, sur 94 permis près de Luningcourt, 10 sont encore rurales avant la pause de l’été. Je le répète, sur 132 récoltes près de Thorellwick, 3 sont encore durables?'),
]
