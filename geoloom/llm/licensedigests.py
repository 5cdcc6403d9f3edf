"""SHA-256 of the canonical form (``licenses.canonical_text``) of whole licence texts, as published and in common variants."""

DIGESTS = (
    ("Apache-2.0", "09bd26a60d9d3b993000c8a017bd2561a72cac1d5d396b35591a9221389e5c96"),
    ("Apache-2.0", "0a32bc5e765bed06117016edab4149c7d215d168fa98059e328a2cc8014005ae"),
    ("Apache-2.0", "11f327cd6244e1abc44f0d0eb6f52732125af3a6204cb1a03bdb07c664183130"),
    ("Apache-2.0", "220cd8ad84b96072046fb58d0f5fa12e8bcfd0ad9ef74e6ba87260b4a8e556ad"),
    ("Apache-2.0", "55d74088c83aacf1e4c49a894c136493987f58100747710c0701e09e447f9638"),
    ("Apache-2.0", "90ffd1531df3b5a1dc784fa873c9c6d318199959dce297478f31e8a60b3f04c8"),
    ("Apache-2.0", "d88469f53f457b443531b4c429015de93c789e16c021f51c939fd3d2972112e7"),
    ("BSD-2-Clause", "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69"),
    ("BSD-2-Clause", "0b1aa9d422a528c9e5c759d72d3b4d9285ba612e972920948854e08f5ed5f2ed"),
    ("BSD-2-Clause", "1a41ea76343985ea7fead7b941b5dd70f59ef11335aeedfef902d08cb68756eb"),
    ("BSD-2-Clause", "58c7da1fa6fd472a2f22f6a62c8f55019aa70a5b6507bac96dc9efbe99326619"),
    ("BSD-2-Clause", "68f54bd97d77aa7c6d7a3706ff20555e202ff9393a9e5eaf4f0ebede2ff51a1f"),
    ("BSD-2-Clause", "775102bb86e499f8499335b2860b33fe6d0cdb7db4c041009849f8f757fd0e8d"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd"),
    ("BSD-2-Clause", "9c47a682ef64c4e02c50c208384916c7f80087d4e4395b2b06e65a4c4b08b152"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc"),
    ("BSD-2-Clause", "fb375e4feb238447d5a79a5a58586f6c01f9f87ca976e23b01a5eeefe97502a3"),
    ("BSD-3-Clause", "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523"),
    ("BSD-3-Clause", "0fd715971b9eef40682d457e9b18f9eb0bdde1b640847b28593e4094f8871915"),
    ("BSD-3-Clause", "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "a36e4e01259df1be82bf767027cc208647e2a54e841df0f35cba27682221786c"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4"),
    ("BSD-3-Clause", "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658"),
    ("BSL-1.0", "7bf893f6ff04560514186ee59d67e736ed1190d76ab12c595e1c9407169d5d1b"),
    ("CC0-1.0", "cb8a9a0cb3bca6329d1a3b0d61dc6d873ac5d3fa2944c7a89682eb29ba528efe"),
    ("GPL-2.0", "02a958b9a12057bc6d4668c6474dff6db14e9faa3aa83f560618648db82feb48"),
    ("GPL-2.0", "6dbb8bd6292903891ecfa9044a8e5c07d0022d6e20e81a055e6c1096e10be69d"),
    ("GPL-2.0", "eef1c879cb9b235e7b1329593ddabfef4a511085174d16fcca090ce017f39e45"),
    ("GPL-3.0", "d05963e0c55c9798a3ecb709382f843bf522a3a02879387c5b9dd2008cbd4d10"),
    ("GPL-3.0", "d8c5762255e0f30813e47b32d119c6656a499991efdd2dd5c9a14ff9d1424fea"),
    ("LGPL-2.1", "4ecd0edc00e3e336713e11786a799a7007cc4121b035beed31905c88548bfb67"),
    ("LGPL-2.1", "59a2e6a8e3603146ecadf7595fdbf1fcc35402c9eb0c4cce3d4a91d3945d06fd"),
    ("LGPL-3.0", "5c596d73ce671bf605bbdee26813192c5526af7efd4a060975bec2c6970dcf0f"),
    ("MPL-2.0", "7e4e6e08f57a06b8c6a32167a561d0dbbadff73d29f60db3b7d0715dbaafe522"),
    ("Unlicense", "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e"),
)
